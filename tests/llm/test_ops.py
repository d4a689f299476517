"""Each operator on small rows against brute force, round trips and odd input."""

import base64
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers as public
import pytest
from oracle import differences
from pyspark.sql import functions as F

from skein.llm import bpe, harmonic, iblt, knnquality, langmask, lattice, linechunks, queries, topk, warc

TEXTS = [(1, "The quick  brown\n\n fox's tail"), (2, None), (3, ""), (4, "   \t "), (5, "naïve 日本語 😀 don't\x85x"), (6, "word " * 3000), (7, "a" * 20_000), (1, "again 1234")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", "clash") for i, t in TEXTS], "doc_id long, text string, lang string, text_ string")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, name):
    assert differences(spark, sf_dir, queries.QUERIES[name], queries.ORACLE_SQL[name]) is None


def test_bpe_is_tiktoken(docs):
    import tiktoken

    path = public.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode_documents(docs, path, public.PATTERN, keep_ids=True).collect()
    want = {t: encoding.encode_ordinary(t or "") for _, t in TEXTS}
    assert sorted((r.doc_id, list(r.ids), bytes(r.decoded).decode()) for r in got) == sorted((i, want[t], t or "") for i, t in TEXTS)
    assert bpe.encode_documents(docs.limit(0), path, public.PATTERN).count() == 0


def test_chunks_are_encoded_as_by_the_library():
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    encode = harmonic._encoder(path)
    assert harmonic._by_ranks(tok)
    texts = ["Plain words, and more (words). Don't we'll it's' \"so\"; x*& a%$# 'tis rock'n'roll's", "Größe, naïve! élan? ŒUVRE: ªº µm ǅ ŉ ƻ ɏ ɐ ʼa", "a1 b2, c.d e-f ... ,, ' 's ''t !a é1", "tail.\n next\n\n  two  blanks ", "日本 語, Ελλάδα. русский! न म", " lead", ".", " .", "x" * 3000 + ", y"]
    texts += [" ".join(texts), "a <|endoftext|> b", "It's we're I'd they've 'S 'LL\r\n\t x\u00a0y \x1c \x85 end  "]
    rng = np.random.default_rng(6)
    signs = list("aAbé ÿ\u0151Ǆ  \n\t.,'s1²½!-_\u024f")
    texts += ["".join(rng.choice(signs, rng.integers(1, 60))) for _ in range(300)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_keeps_ids_beside_null_ones(spark):
    rows = [(9007199254740993, "a b"), (None, "c d e"), (9007199254740995, "f"), (None, None)]
    got = harmonic.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), public.path("byte_bpe_50k.json")).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 0, 9007199254740993, 9007199254740995] and sum(r.doc_id is None for r in got) == 2


def test_packing_loses_nothing(docs):
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = harmonic.pack_documents(docs, path).collect()
    whole = sorted([tok.encode(t or "", add_special_tokens=False).ids + [0] for _, t in TEXTS])
    assert sum(r.length for r in rows) == sum(map(len, whole))
    crc = {zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in rows for ids in whole}
    assert all(r.ids_crc32 in crc for r in rows)
    used: dict[int, list] = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert harmonic.pack_documents(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 341, 342, 700, 1023])
def test_cuts_add_up(n):
    assert sum(harmonic.cut_rest(n)) == n and all(x > 0 for x in harmonic.cut_rest(n))


def test_warc_round_trip(spark):
    big = "é<p>" * 20_000
    rows = [(5, "u", "x" * 200), (2, "u\r\nv", "x" * 200), (9, None, "x" * 200), (1, "u", "short"), (3, "u", "short"), (4, "u", None), (7, "u", big), (8, "u", big), (6, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 10), (None, "u", "x" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    for page, _, html in rows:
        body = (html or "").encode()
        r = got[page]
        assert (r.payload_bytes, r.payload_digest, r.status) == (len(body), hashlib.sha256(body).hexdigest(), "ok")
    assert {p: r.refers_to for p, r in got.items() if r.record_type == "revisit"} == {5: 2, 9: 2, 8: 7}
    assert warc.round_trip(pages.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "u", big), (1, "u", big)], "page_id long, url string, html string")
    assert [r.payload_bytes for r in warc.round_trip(twice).collect()] == [len(big.encode())] * 2


def test_warc_damage(spark):
    message = warc.HTTP_HEAD + warc.chunked(b"y" * 50_000)
    parts = [message[i : i + 20_000] for i in range(0, len(message), 20_000)]
    rows = [(f"o{case}", n, None if n < len(parts) else len(message) + (case == 2), 1, "u", None, bytearray(b)) for case in range(3) for n, b in enumerate(parts, 1) if (case, n) != (1, 2)]
    d = spark.createDataFrame(rows, "origin_id string, segment int, total_length long, page_id long, url string, stated_digest string, block binary")
    got = {r.record_id: r.status for r in warc.reassemble(d).collect()}
    assert got["o0"] == "ok" and "missing" in got["o1"] and "total" in got["o2"]
    with pytest.raises(warc.BadFraming):
        warc.dechunked(b"5\r\nabc")


def test_topk_odd_vectors_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(120)]
    rows += [(200 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(20)] + [(400, None), (401, [1.0, None, 0.0, 0.0]), (402, [float("nan")] * 4), (403, [float("inf")] * 4), (50, [9.0, 1.0]), (450, [])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect()
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    want, seen = [], set()
    for i, v in sorted(ok, key=lambda x: (x[0], x[1])):
        if i % 50 == 0 and i not in seen:
            seen.add(i)
            s = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i and len(w) == len(v)))[:5]
            want += [(i, k, j, -score) for k, (score, j) in enumerate(s, 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)


def segmentations(text, p):
    if not text:
        return 1.0
    total = 0.0
    for k in range(1, len(text) + 1):
        if text[:k] in p:
            total += p[text[:k]] * segmentations(text[k:], p)
    return total


def test_lattice_sums_all_segmentations():
    p = {"▁": 0.1, "▁a": 0.2, "a": 0.1, "b": 0.05, "ab": 0.07, "▁ab": 0.02, "ba": 0.01}
    trie = {}
    for name, v in p.items():
        for k in range(1, len(name)):
            trie.setdefault(name[:k], None)
        trie[name] = math.log(v)
    m = lattice.Pieces(trie, [math.log(0.001)] * 256, -1.0)
    for word in ("a", "ab", "abab", "baab"):
        assert lattice.word_log_p(word, m) == pytest.approx(math.log(segmentations("▁" + word, p)))
    assert lattice.word_log_p("aé", m) == pytest.approx(math.log(segmentations("▁a", p) * 0.001**2))


def test_lattice_base_score(spark):
    rows = [(i, t) for i, t in TEXTS if i != 1] + [(i, f"the common words w{i} w{i % 3}") for i in range(20, 60)]
    got = {r.doc_id: r for r in lattice.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), public.path("piece_bpe_32k.model")).collect()}
    words = {i: (t or "").encode().lower().split() + [b"\0end"] for i, t in rows}
    count: dict[bytes, int] = {}
    for i, ws in words.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for w in ws:
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, ws in words.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws), sum(w in count for w in ws), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in ws))
        assert got[i].score < 0


def learned_in_log_space(words, ends, path):
    """The pieces after expectation maximisation over all words, one word after another, in log space."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.vocab_size()
    names = [None if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) or lattice.MARK in sp.id_to_piece(i)[1:] else sp.id_to_piece(i) for i in range(size)]
    byte_ids = {int(sp.id_to_piece(i)[3:-1], 16): i for i in range(size) if sp.is_byte(i)}
    place = {x: i for i, x in enumerate(names) if x is not None}
    counts = [0.0] * size
    for word, c in words.items():
        for i in sp.encode(word):
            counts[i] += c
    for _ in range(7):
        m = lattice.Pieces.of(names, byte_ids, counts, ends)
        counts = [0.0] * size
        for word, c in words.items():
            text = lattice.MARK + word
            edges = []
            for s in range(len(text)):
                if m.trie.get(text[s]) is None:
                    edges.append((s, s + 1, m.bytes_log_p(text[s]), [byte_ids[b] for b in text[s].encode()]))
                edges += [(s, e, m.trie[text[s:e]], [place[text[s:e]]]) for e in range(s + 1, min(len(text), s + 20) + 1) if m.trie.get(text[s:e]) is not None]
            into, out = [-math.inf] * (len(text) + 1), [-math.inf] * (len(text) + 1)
            into[0] = out[-1] = 0.0
            for s, e, p, _ in edges:
                into[e] = np.logaddexp(into[e], into[s] + p)
            for s, e, p, _ in reversed(edges):
                out[s] = np.logaddexp(out[s], out[e] + p)
            for s, e, p, ids in edges:
                for i in ids:
                    counts[i] += c * math.exp(into[s] + p + out[e] - into[-1])
    return lattice.Pieces.of(names, byte_ids, counts, ends)


def same_scores(spark, rows):
    """Scores are those of pieces learned from every training word."""
    path = public.path("piece_bpe_32k.model")
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    words: dict[str, int] = {}
    for t in train:
        for w in t.encode().lower().split():
            words[w.decode()] = words.get(w.decode(), 0) + 1
    m = learned_in_log_space(words, len(train), path)
    got = {r.doc_id: r.score for r in lattice.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    for i, t in rows:
        assert got[i] == pytest.approx((m.end_log_p + sum(lattice.word_log_p(w.decode(), m) for w in t.encode().lower().split())) / math.log(10), rel=1e-4)


def test_lattice_learns_from_rare_words(spark):
    syllables = ["ka", "lo", "mi", "ren", "tus", "vor", "shi", "que", "bla", "zen", "dor", "fy"]
    name = lambda k: "".join(syllables[k // 12**j % 12] for j in range(4))
    frequent = [(k, " ".join(name(j) for j in range(k * 400, k * 400 + 400)) + " the of") for k in range(51)]
    rare = [(100 + k, " ".join(f"xylograph{k}ic{j}ness" for j in range(40))) for k in range(20)]
    same_scores(spark, frequent + [(1000 + i, t) for i, t in frequent] + rare)


def test_lattice_learns_from_words_of_bytes(spark):
    """Long words of a script without pieces, kept whole: their probability is far below the least double."""
    lao = [chr(c) for c in range(0x0E81, 0x0EAF) if chr(c).isalpha()]
    long = lambda k: "".join(lao[(k + 3 * j) % len(lao)] for j in range(70))
    same_scores(spark, [(k, "the of and in to " * 4000) for k in range(40)] + [(100 + k, long(k)) for k in range(3)])


def test_fingerprints_against_sets(spark):
    many = "\n".join(f"Paragraph number {i} ends here." for i in range(400))
    rows = [(3, "One line.\nTwo line.\nThree."), (1, many), (2, many.replace("7", "x")), (4, None), (5, ""), (6, "é" * 9), (9, "One line.\nTwo line.\nThree.")]
    got = {r.doc_id: r for r in iblt.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted((i, t or "") for i, t in rows)
    of = lambda t: {p.strip(" ") for p in re.split(iblt.PARAGRAPH_END, t)} - {""}
    like = lambda a, b: len(of(a) & of(b)) / len(of(a) | of(b)) if of(a) | of(b) else 1.0
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].near_edited == pytest.approx(like(t, edited)) and got[i].near_next == pytest.approx(like(t, after))
    assert got[3].fingerprint == got[9].fingerprint
    assert iblt.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_language_masks(spark):
    words = {"en": "the and of that with", "fr": "le la des pour avec", "de": "der die und nicht für"}
    rows = [(i, " ".join(words[lang].split()[(i + j) % 5] for j in range(30)), lang) for i, lang in enumerate(["en", "fr", "de"] * 20)]
    filters = langmask.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    ask = spark.createDataFrame([(1, "that with the", None), (2, "pour la", None), (3, "nicht die", None), (4, None, "en"), (5, "12 !!", "en"), (6, "日本", "en")], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in langmask.predict(ask, filters).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5)] == ["en", "fr", "de", "und", "und"] and got[6].lang_pred in words
    assert all(0 <= got[i]["score_"] <= 1 for i in got)
    nothing = langmask.learn(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in langmask.predict(ask, nothing).collect()} == {"und"}


def test_quality_neighbours(spark):
    good = [(i, f"Plain words number {i} follow each other here.", 1) for i in range(40)]
    bad = [(100 + i, "BUY!! NOW!! " * 5 + f"w{i}***", 0) for i in range(40)]
    d = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    model = knnquality.learn(d, d.where("doc_id % 2 = 0").select("doc_id", "quality"))
    got = {r.doc_id: r.predicted for r in knnquality.predict(d.select("doc_id", "text"), model).collect()}
    assert all(got[i] == q for i, _, q in good + bad)
    odd = knnquality.predict(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), model).collect()
    assert all(r.score == pytest.approx(model.prior) for r in odd)
    empty = knnquality.learn(d.limit(0), d.limit(0).select("doc_id", "quality"))
    assert {r.score for r in knnquality.predict(d, empty).collect()} == {0.5}


def test_line_chunks(spark):
    passage = " ".join(f"Sentence number {i} of the shared passage is here." for i in range(12))
    own = lambda k: " ".join(f"Own words {k} {j} stand in this place." for j in range(6))
    rows = [(1, own(1) + "\n" + passage + "\n" + own(2)), (2, own(3) + "\n" + passage), (3, own(4)), (4, own(4)), (5, None), (6, ""), (7, "One line only"), (None, own(4))]
    got = {r.doc_id: r for r in linechunks.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1] and got[3].text == own(4) and got[7].text == "One line only"
    assert got[4].text == "" and got[None].text == own(4) and got[5].text is None and got[6].text == ""
    assert own(3)[:60] in got[2].text and len(got[2].text) < len(rows[1][1]) / 2 + 200


def test_line_dedup_takes_short_passages(spark):
    """Passages of 50 to 100 words, each between foreign lines in two documents: all of them go from the second, and nothing else."""
    import corpus_pipeline

    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(5000)]
    sentence = lambda n: " ".join(rng.choice(words, n)) + ". "

    def prose(n):
        out = []
        while n > 0:
            out.append(sentence(min(n, int(rng.integers(1, 25)))))
            n -= len(out[-1].split())
        return "".join(out)

    rows, want = [], {}
    for k in range(150):
        passage = prose(int(rng.integers(50, 101))) + "\n"
        a, b, c, d = (prose(60) + "\n" for _ in range(4))
        rows += [(2 * k, a + passage + b, "en", "s", 0), (2 * k + 1, c + passage + d, "en", "s", 0)]
        want |= {2 * k: a + passage + b, 2 * k + 1: c[:-1] + d}  # the line break before the passage is common too
    # short lines are extended to both sides; a line alone, or a run too short, stays
    rows += [(900, "Oh. No. Ah. This is a line of more than forty characters. So. It. Is. ", "en", "s", 0), (901, "Own one. Oh. No. Ah. This is a line of more than forty characters. So. It. Is. Own two. ", "en", "s", 0), (902, "Else. Oh. No. Other. ", "en", "s", 0), (903, None, "en", "s", 0), (None, rows[0][1], "en", "s", 0)]
    want |= {900: rows[300][1], 901: "Own one. Own two. ", 902: rows[302][1], 903: None, None: rows[0][1]}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert [(k, got.get(k), t) for k, t in want.items() if got.get(k) != t] == []


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, sf_dir)
    assert kept.columns == corpus_pipeline.COLUMNS
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    right = docs.join(labels, "doc_id").join(kept.select("doc_id", F.lit(1).alias("kept")), "doc_id", "left")
    assert right.where((F.col("quality") == 1) & F.col("kept").isNull()).count() <= 0.05 * right.count()
    twins = spark.createDataFrame([(i, f"{w} " * 30, "en", "s", 1) for i, w in enumerate(["one two three four five six", "one two three four five six", "seven eight nine ten eleven twelve"])], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, twins, sf_dir).collect()) == [0, 2]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language ID", "line dedup", "MinHash near-dedup", "packing"]


def test_language_grams_and_decision_against_brute_force(spark):
    """N-grams by code points are those of the letter runs; predictions are those of plain sets of n-grams."""
    import collections

    import regex

    letters = langmask._letters("test")

    def brute(word):
        runs = [f" {run} " for run in regex.findall(r"[\p{L}\p{M}]+", word.lower())]
        return [run[i : i + n] for run in runs for n in langmask.SIZES for i in range(len(run) - n + 1)]

    words = ["The", "a", "12", "don't", "naïve,", "日本語x", "--", "é1é", "Straße", "İx", "x" * 5000]
    hashes, number = langmask.grams(words, letters)
    names: dict[int, str] = {}
    for k, w in enumerate(words):
        assert sorted(collections.Counter(brute(w)).values()) == sorted(collections.Counter(hashes[number == k].tolist()).values())
        for g in set(brute(w)):
            names.setdefault(g, w)

    rng = np.random.default_rng(4)
    vocab = {lang: ["".join(rng.choice(list(some), rng.integers(2, 8))) for _ in range(60)] for lang, some in (("xx", "abcdefgh"), ("yy", "efghijkl"), ("zz", "ijklmnop"))}
    rows = [(i, " ".join(rng.choice(vocab[lang], rng.integers(1, 40))), lang) for i, lang in enumerate(["xx", "yy", "zz", "yy"] * 40)]
    rows += rows[:3] + [(900, "abc " * 20_000, "xx"), (901, None, "xx"), (902, "ab", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = collections.defaultdict(collections.Counter)
    for _, t, lang in rows:
        if t and lang:
            known[lang].update(g for w in t.split() for g in brute(w))
    holds = {lang: {g for g, c in found.items() if c >= langmask.MIN_RATE * sum(found.values())} for lang, found in known.items()}
    got = {(r.doc_id, r.text): r for r in langmask.predict(d, langmask.learn(d)).collect()}
    right = 0
    for i, t, lang in rows:
        if t:
            every = [g for w in t.split() for g in brute(w)]
            hits = {k: sum(g in s for g in every) for k, s in holds.items()}
            best = max(sorted(hits), key=hits.get)
            assert hits[got[i, t].lang_pred] >= hits[best] - 0.01 * len(every)  # filters may hold a little more
            right += lang == got[i, t].lang_pred
    assert right >= 0.95 * len(rows) - 3
    empty = langmask.predict(d.limit(0), langmask.learn(d))
    assert empty.count() == 0


def test_line_chunks_odd_rows(spark):
    """Clashing columns, an empty table, ids that repeat, a very long text."""
    long = " ".join(f"Sentence {i} of a very long text stands here." for i in range(20_000))
    d = spark.createDataFrame([(1, long, "a"), (2, "own words stand first.\n" + long, "b"), (3, "x y", "c"), (3, "x y", "d")], "doc_id long, text string, key string").selectExpr("*", "key AS h", "key AS line", "key AS chunks")
    got = {r.doc_id: r for r in linechunks.remove_repeated(d, carry=("key", "line")).collect()}
    assert got[1].text == long and got[1].n_lines == 20_000 and got[2].n_removed > 19_900 and got[2].line == "b"
    assert linechunks.remove_repeated(d.limit(0)).count() == 0 and linechunks.remove_repeated(d).count() == 4


def test_fingerprints_odd_rows(spark):
    rows = [(None, "A line.\nB line."), (None, "C line."), (7, "same\ntext"), (7, "same\ntext"), (1, "word " * 50_000)]
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, bucket int").selectExpr("*", "1 AS h", "'x' AS s")
    got = iblt.fingerprints(d).collect()
    order = [1, 7, 7, None, None]
    assert sorted(map(str, order)) == sorted(str(r.doc_id) for r in got) and {r.near_next for r in got if r.doc_id == 7} == {1.0, 0.0}


def test_lattice_odd_rows(spark):
    path = public.path("piece_bpe_32k.model")
    d = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "y"), (2, "z" * 20_000, "w"), (None, None, "v")], "doc_id long, text string, word string").selectExpr("*", "1 AS id", "2 AS row", "3 AS c")
    got = lattice.score_documents(d, path).collect()
    assert len(got) == 4 and len({r.score for r in got if r.doc_id == 1}) == 1 and all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lattice.score_documents(d.limit(0), path).count() == 0


def test_topk_empty_table_and_clashing_columns(spark):
    d = spark.createDataFrame([(50, [1.0, 0.0], "x"), (3, [0.5, 0.5], "y")], "vec_id long, embedding array<double>, block string").selectExpr("*", "1 AS dim", "2 AS v")
    assert [(r.query_id, r.vec_id, r.score) for r in topk.top_k(d).collect()] == [(50, 3, 256 * 128)]
    assert topk.top_k(d.limit(0)).count() == 0


def test_warc_clashing_columns(spark):
    d = spark.createDataFrame([(1, "u", "x" * 200, "a"), (2, "u", "x" * 200, "b")], "page_id long, url string, html string, payload string").selectExpr("*", "1 AS record_type", "2 AS segment")
    assert {(r.page_id, r.record_type) for r in warc.round_trip(d).collect()} == {(1, "response"), (2, "revisit")}
