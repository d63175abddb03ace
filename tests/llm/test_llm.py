"""Each operator against brute force on a small table with nulls, empty and long texts, ties and odd columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from tagwright.llm import bpe, common, decontaminate, exact_dedup, gbt, html_extract, lang_id, ngram_join, pii, quality, shared_keys, suffix_dedup, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, h long, key long, node long, norm string"
_rng = random.Random(4)
WORDS = ["".join(_rng.choice("abcdeé") for _ in range(_rng.randint(1, 7))) for _ in range(300)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    """Texts with copies, near copies, shared passages, empty, null, short and long ones; ids with gaps."""
    rng = random.Random(1)
    base = prose(120, 100)
    passage = prose(60, 200)
    texts = [None, "", " \n\t", "Ab", "one two three", "ONE  two\tthree", "one two three", "12 + 34", "x" * 3000, prose(4000, 9)]
    texts += [base, base, base.upper(), base.replace(" ", "  ")]
    for i in range(12):
        w = base.split(" ")
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = f"new{i}{rng.randrange(99)}"
        texts.append(" ".join(w))
    texts += [f"{prose(30, 300 + i)} {passage} {prose(25, 400 + i)}" for i in range(6)]
    texts += [prose(rng.randint(1, 80), 500 + i) for i in range(20)]
    ids = rng.sample(range(-5, 200), len(texts))
    return list(zip(ids, texts, strict=True))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 1, 2, 3, "n") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3)


def test_bpe_matches_the_library(spark, docs, rows):
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.load_ranks(bpe.read_vocab(path))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.round_trip(docs, path, public_tokenizers.PATTERN).collect()}
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(bpe._le32(ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    both = bpe.decode_documents(bpe.encode_documents(docs, path, public_tokenizers.PATTERN), path)
    assert {r.doc_id: r.text for r in both.collect()} == {i: t or "" for i, t in rows}
    codec = bpe.Codec(bpe.read_vocab(path), public_tokenizers.PATTERN)
    rng = random.Random(2)
    parts = ["a", "the", " ", "\n", "\t ", "é", "😀", "'s", "\x1c", "\x85", "12", "!?", " ", "\U0003ddf8", "  "]
    for _ in range(400):
        s = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        assert codec.encode(s) == enc.encode_ordinary(s)
        assert codec.decode(codec.encode(s)) == s


def test_worker_keeps_tables_of_one_operator():
    raw = bpe.read_vocab(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert bpe._codec(raw, public_tokenizers.PATTERN) is bpe._codec(raw, public_tokenizers.PATTERN)
    assert common._HELD["bpe"]
    common.held("lang_id")["x"] = 1
    assert not common._HELD.get("bpe") and common.held("lang_id") == {"x": 1}


def test_bpe_chunks_are_bounded_and_frequent_ones_stay(monkeypatch):
    codec = bpe.Codec(bpe.read_vocab(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    text = "".join(f" often w{i}" for i in range(100))
    whole = codec.pieces_le32(text)
    codec.memo.clear()
    monkeypatch.setattr(bpe, "CACHE", 20)
    for _ in range(2):
        assert codec.encode_le32(text) == whole
        assert len(codec.chunks) + len(codec.chunks.older) <= 20 and "often" in codec.chunks | codec.chunks.older
    assert not codec.memo.get(" often")  # held once, as a chunk


def test_bpe_simulation_equals_states(monkeypatch):
    raw = bpe.read_vocab(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    full = bpe.Transducer(bpe.load_ranks(raw))
    monkeypatch.setattr(bpe, "CACHE", 0)
    for w in (*WORDS, "x" * 500, "naïveté", "qzxwvjk" * 20):
        a = full._simulate(0, w.encode())
        assert full.encode(w.encode()) in (a, [full.ranks.get(w.encode())])


def test_utf8_stream():
    data = "aé€😀z".encode()
    for cut in range(len(data)):
        m = bpe.Utf8Stream()
        assert m.feed(data[:cut]) + m.feed(data[cut:]) + m.flush() == "aé€😀z"
    m = bpe.Utf8Stream()
    assert m.feed(b"a\xe2\x82") + m.flush() == "a�"


def _low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def test_decontaminate(spark, docs, rows):
    passage = prose(60, 200).split()
    items = [(1, " ".join(passage[5:40])), (20, " ".join(passage[30:33])), (3, None), (None, prose(15, 400)), (5, "Ab"), (5, "Ab"), (6, "")]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    win = defaultdict(set)
    for i, t in items:
        ws = word.findall(_low(t))
        m = min(10, len(ws))
        for a in range(len(ws) - m + 1 if ws else 0):
            win[tuple(ws[a : a + m])].add("null" if i is None else str(i))
    expect = {}
    for i, t in rows:
        ws, hit, who = word.findall(_low(t)), set(), set()
        for m in {len(k) for k in win}:
            for a in range(len(ws) - m + 1):
                if tuple(ws[a : a + m]) in win:
                    hit.update(range(a, a + m))
                    who |= win[tuple(ws[a : a + m])]
        expect[i] = (len(ws), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit))
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.report(docs, bench).collect()}
    assert got == expect
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, e in expect.items() if not e[4]}
    assert decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.report(docs.limit(0), bench).count() == 0
    assert decontaminate.cut_words("A b, c d!", [{"start": 1, "end": 3}]) == "A  d!"
    assert decontaminate.remove_spans(docs, bench).count() <= len(rows)


def test_decontaminate_in_parts(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(i, prose(30, 300 + i)) for i in range(6)], "item_id long, text string")
    one = {tuple(r) for r in decontaminate.report(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 300)
    assert {tuple(r) for r in decontaminate.report(docs, bench).collect()} == one


def test_warc(spark):
    big = "y" * 1500
    pages = [(1, "http://A.com/1", big), (2, "http://a.com:80/1", big), (2, "http://a.com:80/1", big), (None, "http://b.com/q?z=1#f", big), (5, None, None), (6, "http://[bad", ""), (7, "u\n v", "é" * 700), (8, "https://a.com/1", "WARC/1.1\r\n\r\n" * 200), (9, "x", "s"), (10, "x", "s")]
    a = warc.Archive.write(spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, first int"))
    got = sorted(((r.page_id is not None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in a.scan().collect()))
    expect = []
    for i, _, h in pages:
        raw = (h or "").encode()
        again = h == big and i != 2
        expect.append((i is not None, i or 0, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 2 if again else None))
    assert got == sorted(expect)
    found = a.lookup(spark.createDataFrame([("http://a.com/1",), ("nope",)], "url string"), with_payload=True).collect()
    assert Counter(r.page_id for r in found) == {1: 1, 2: 2, 8: 1} and any(r.payload == big.encode() for r in found)
    assert warc.url_key("http://m.Example.com:8080/a?b#c") == "com,example,m:8080)/a?b"
    assert warc.Archive.write(a.scan().selectExpr("page_id", "url", "cast(null as string) html").limit(0)).scan().count() == 0


def _components(rows):
    sets = {}
    for i, t in rows:
        ws = (t or "").encode().lower().split()
        sets[i] = {tuple(ws[a : a + 5]) for a in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} - {()}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n) and find(a) != find(b):
                    x, y = sorted((find(a), find(b)))
                    up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard(spark, docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == _components(rows)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for _, c in got.values()}


def test_jaccard_small_tiles(spark, monkeypatch):
    """Chains of texts that are linked only through others, cut into many tiles and turns."""
    words = prose(60, 1).split()
    rows = []
    for i in range(24):
        w = list(words)
        for j in range(i):
            w[(j * 7) % 60] = f"z{j}"
        rows.append((100 - i, " ".join(w)))
    for name, value in (("TILE_ROWS", 4), ("TILE_PAIRS", 1), ("HUB_ROWS", 3)):
        monkeypatch.setattr(ngram_join, name, value)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame(spark, rows)).collect()}
    assert got == _components(rows)


def test_jaccard_across_windows(spark, monkeypatch):
    """Edits of one text that link with that text only, all their shared keys hot, in several windows, blobs and tiles."""
    for name, value in (("HELD", 100), ("SLOTS", 3), ("SLOT_KEYS", 40), ("TILE_ROWS", 3), ("TILE_PAIRS", 2)):
        monkeypatch.setattr(ngram_join if name.startswith("TILE") else shared_keys, name, value)
    w = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*w[: 5 + 2 * i], f"new{i}", *w[6 + 2 * i :]])) for i in range(24)] + [(99, " ".join(w))]
    rows += [(200 + i, " ".join([*w[:20], *prose(40, 50 + i).split()])) for i in range(12)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame(spark, rows).coalesce(1)).collect()}
    assert got == _components(rows)


def test_jaccard_near_copy_of_a_hot_text(spark, monkeypatch):
    """One near copy beside many exact copies, a window for each text."""
    monkeypatch.setattr(shared_keys, "HELD", 8)
    w = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w)) for i in range(1, 41)] + [(99, " ".join([*w[:20], "new", *w[21:]])), (100, prose(60, 5))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame(spark, rows).coalesce(1)).collect()}
    assert got == _components(rows)


def test_word_hashes(monkeypatch):
    """Words of many texts hashed at once are those that a split gives, over pieces and for long words."""
    import pyarrow as pa

    monkeypatch.setattr(ngram_join, "PIECE", 64)
    monkeypatch.setattr(ngram_join, "LONG_WORD", 20)
    monkeypatch.setattr(ngram_join, "_WORDS", [])
    rng = random.Random(8)
    texts = [None, "", " ", "a", "A b", "ab c", "x" * 300, " y" * 90 + "z" * 70 + " y"]
    texts += ["".join(rng.choice("abAB é \t\n\x1c\x85") for _ in range(rng.randrange(160))) for _ in range(200)]
    words, back = {}, {}
    got = list(ngram_join.sets_of(pa.array(texts).slice(0), 1))
    for t, sig in zip(texts, got, strict=True):
        ws = set((t or "").encode().lower().split())
        assert len(sig) == len(ws)
        if len(ws) == 1:
            assert words.setdefault(sig[0], w := next(iter(ws))) == w and back.setdefault(w, sig[0]) == sig[0]
    for t, sig in zip(texts, ngram_join.sets_of(pa.array(["q", *texts]).slice(1), 2), strict=True):
        ws = (t or "").encode().lower().split()
        assert len(sig) == len({tuple(ws[i : i + 2]) for i in range(max(1, len(ws) - 1))} - {()})
    for a, x in zip(texts, got, strict=True):
        for b, y in zip(texts[:40], got[:40], strict=True):
            both = set((a or "").encode().lower().split()) & set((b or "").encode().lower().split())
            assert len(set(x.tolist()) & set(y.tolist())) == len(both)


def test_jaccard_odd_tables(spark):
    assert ngram_join.jaccard_components(frame(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (7, None), (8, "A B c d e f")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame(spark, rows)).collect())
    assert got == {(None, 2, None): 1, (3, 2, 3): 2, (7, 0, 7): 1, (8, 2, 3): 1}


PROBE = [(None, "a b c d e f"), (None, "a b c d e f"), (1, "other text"), (3, "other text"), (3, "q q q"), (3, "q q q"), (None, None), (5, "")]


def _clashing(spark, rows):
    """A table with column names that a careless join would use itself."""
    schema = "doc_id long, text string, rk string, cnt int, cnt_ int, `a.b` string, __keep long, __bad long, h long, spans int"
    return spark.createDataFrame([(i, t, "k", 1, 2, "x", 3, 4, 5, 6) for i, t in rows], schema)


def test_stages_keep_rows_not_ids(spark):
    """Null ids, ids of several texts, repeated rows, clashing names and empty tables in the filtering stages."""
    table = _clashing(spark, PROBE)
    some = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    copies = exact_dedup.drop_copies(table)
    assert some(copies) == {(None, "a b c d e f"): 1, (1, "other text"): 1, (3, "q q q"): 1, (5, ""): 1}
    near = ngram_join.keep_one(table)
    assert some(near) == {(None, "a b c d e f"): 2, (1, "other text"): 1, (3, "q q q"): 1, (None, None): 1, (5, ""): 1}
    bench = spark.createDataFrame([(1, "other text")], "item_id long, text string")
    clean = decontaminate.drop_contaminated(table, bench)
    assert some(clean) == Counter(r for r in PROBE if r[1] != "other text")
    known = lang_id.keep_known(table.selectExpr("*", "'en' as lang"))
    for out, names in ((copies, table.columns), (near, table.columns), (clean, table.columns), (known, [*table.columns, "lang"])):
        assert out.columns == names
    none = _clashing(spark, [])
    for step in (exact_dedup.drop_copies, ngram_join.keep_one, lambda d: decontaminate.drop_contaminated(d, bench)):
        assert step(none).count() == 0


def test_keep_one_keeps_null_ids(spark):
    rows = [(None, "a b c d e f"), (None, None), (3, "a b c d e f"), (8, "A B c d e f")]
    got = Counter((r.doc_id, r.text) for r in ngram_join.keep_one(frame(spark, rows)).collect())
    assert got == {(None, "a b c d e f"): 1, (None, None): 1, (3, "a b c d e f"): 1}


def test_exact(spark, docs, rows):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    groups = defaultdict(list)
    for i, n in norm.items():
        groups[n].append(i)
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    for i, n in norm.items():
        r, g = got[i], groups[n]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(g), len(g), i == min(g), hashlib.sha256(n.encode()).hexdigest())
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {min(g) for g in groups.values()}
    odd = exact_dedup.exact_dedup(frame(spark, [(None, "a"), (4, "a"), (4, "a"), (None, None)])).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in odd) == {(None, 4, 3, False): 1, (4, 4, 3, True): 2, (None, None, 1, True): 1}
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 50), (60, 61), (61, 60), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in common.components(links).collect()}
    assert {x: c for x, c in got.items() if x <= 30} == dict.fromkeys(range(31), 0) and got[61] == 60


def test_language(spark):
    en = ["the house and the dog with water " * k for k in range(2, 40)]
    de = ["der hund und das haus mit wasser ist " * k for k in range(2, 40)]
    rows = [(i, t, lang) for i, (t, lang) in enumerate([*((t, "en") for t in en), *((t, "de") for t in de)])]
    rows += [(900, None, "en"), (901, "12 34 !", "de"), (902, "", None), (None, "the dog", "en"), (903, "der hund mit dem haus", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.learn(df)
    got = {r.doc_id: r for r in lang_id.identify(df, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[: len(en) + len(de)])
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"} and got[903].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values()) and not got[None].held_out
    kept = lang_id.keep_known(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, *_ in rows} - {900, 901, 902}
    none = df.withColumn("lang", df.lang.substr(99, 1)).where("1 = 0")
    assert lang_id.learn(none) is None and lang_id.identify(df, None).where("lang_pred <> 'und'").count() == 0
    mixed = lang_id.Labeller(model).words(["the dog and the house der hund und das haus"])[0][1].argmax(axis=1)
    assert mixed[0] != mixed[-1]


def test_language_of_long_tokens():
    """A text without spaces is judged by all its letters, not by its first ones."""
    rng = random.Random(5)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    rows = [(" ".join(make(x, 6) for _ in range(40)), lang) for x, lang in (("abcd", "aa"), ("wxyz", "zz")) for _ in range(20)]
    label = lang_id.Labeller(lang_id.fit(rows))
    (lang, score), (other, _) = label.documents([make("abcd", 60) + make("wxyz", 600), make("wxyz", 60) + make("abcd", 600)])
    assert (lang, other) == ("zz", "aa") and score < 0.97


def test_quality(spark):
    rows = [(i, prose(40, i), "en", f"s{i % 3}", 200) for i in range(60)] + [(100 + i, "| ".join(prose(40, i).split()) + "%%% ***", "en", f"t{i % 3}", 200) for i in range(60)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(40)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score(docs, quality.learn(docs, labels)).collect()}
    assert all(got[i].keep for i in range(40, 60)) and not any(got[100 + i].keep for i in range(40, 60))
    assert quality.score(docs, quality.learn(docs, labels.limit(0))).where("keep").count() == len(rows)
    assert quality.score(docs.limit(0), None).count() == 0


def test_repeats(spark, docs, rows):
    own = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for a in range(len(b) - 49):
            own.setdefault(b[a : a + 50], i)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, with_text=True).collect()}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - 49):
            if own[b[a : a + 50]] < i:
                gone[a : a + 50] = b"\x01" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for a in range(len(b)) if gone[a] and (a == 0 or not gone[a - 1]))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    same = "q" * 10 + prose(30, 3)
    odd = Counter((r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(frame(spark, [(None, same), (4, same), (4, same), (9, same + "!"), (9, None)])).collect())
    assert odd == {(None, 0): 1, (4, 0): 2, (9, len(same.encode())): 1, (9, 0): 1}
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_repeats_at_several_places(spark):
    """A passage twice in one document, in two texts of one id, and a long run, over several tasks."""
    a, b, c = (prose(50, k) for k in (11, 12, 13))
    rows = [(1, a + prose(9, 20)), (2, "q" * 3000), (3, prose(9, 21) + b), (4, c + "."), (5, b + c + b), (6, "q" * 3000)]
    rows += [(7, a + " x " + a + prose(9, 22) + a), (8, c + prose(9, 23)), (8, prose(9, 24) + c), (9, b + "-" + b + c)]
    own = {}
    for i, t in rows:
        for k in range(len(t.encode()) - 49):
            own.setdefault(t.encode()[k : k + 50], i)
    want = Counter()
    for i, t in rows:
        raw, gone = t.encode(), set()
        for k in range(len(raw) - 49):
            if own[raw[k : k + 50]] < i:
                gone.update(range(k, k + 50))
        want[i, len(raw), len(gone)] += 1
    whole = {name: spark.conf.get(name) for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.enabled")}
    try:
        for slices, split in ((len(rows), "1k"), (1, "128m")):  # a task for each document, and one for all, larger ids first
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.adaptive.enabled", slices == 1)
            table = spark.createDataFrame(spark.sparkContext.parallelize(rows[::-1], slices), "doc_id long, text string")
            assert Counter((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(table).collect()) == want
    finally:
        for name, value in whole.items():
            spark.conf.set(name, value)


def test_run_index():
    rng = random.Random(0)
    base = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(50, 90))) for _ in range(6)]
    segs = [rng.choice(base) + b"xy"[: rng.randrange(3)] for _ in range(30)]
    docs = [i // 2 for i in range(30)]
    own = {}
    for s, d in zip(segs, docs, strict=True):
        for a in range(len(s) - 49):
            own[s[a : a + 50]] = min(d, own.get(s[a : a + 50], 99))
    index = suffix_dedup.RunIndex(segs, docs, 50)
    for s, f in zip(segs, index.first_documents(segs), strict=True):
        assert list(f) == [own[s[a : a + 50]] for a in range(len(s) - 49)]
    assert index.runs < index.n / 3


def test_judge(monkeypatch):
    """Spans of grouped segments against brute force; the index takes those alone that may share a string."""
    import numpy as np
    import pyarrow as pa

    rng, rows, built = random.Random(5), [], []
    base = [bytes(rng.choice(b"ab ") for _ in range(200)) for _ in range(3)] + [b"q" * 120]
    for node in range(90):
        at = rng.randrange(len(base[node % 4]) - 60)
        raw = bytes(rng.choice(b"xyz") for _ in range(rng.randrange(40))) + base[node % 4][at : at + rng.randrange(17, 120)] + bytes(rng.choice(b"xyz") for _ in range(rng.randrange(40)))
        for m, lo, hi in suffix_dedup.runs_of(np.frombuffer(raw, np.uint8), 50):
            for k, x, y in zip(m.tolist(), lo.tolist(), hi.tolist(), strict=True):
                rows += [(k, 0, node // 2, node, z, raw[z : min(z + 64, y) + 49], None) for z in range(x, y, 64)]
    rows.sort(key=lambda r: r[:2])
    least = {}
    for k, _, d, _, _, s, _ in rows:
        for i in range(len(s) - 49):
            least[k, s[i : i + 50]] = min(d, least.get((k, s[i : i + 50]), 99))
    want = {(n, z + i + j) for k, _, d, n, z, s, _ in rows for i in range(len(s) - 49) if least[k, s[i : i + 50]] < d for j in range(50)}

    class Counted(suffix_dedup.RunIndex):
        def __init__(self, segs, docs, length):
            built.append(len(segs))
            super().__init__(segs, docs, length)

    monkeypatch.setattr(suffix_dedup, "RunIndex", Counted)
    judge = lambda part: {(n, i) for b in suffix_dedup._judge(50)(iter(part)) for n, x, y in zip(b["node"].to_pylist(), b["start"].to_pylist(), b["key"].to_pylist(), strict=True) for i in range(x, y)}
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), suffix_dedup._SEG_ARROW, strict=True)], schema=suffix_dedup._SEG_ARROW)
    assert want and judge([batch(rows)]) == want and 0 < built[0] < len(rows)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 500)
    assert judge([batch(rows[i : i + 7]) for i in range(0, len(rows), 7)]) == want
    del built[:]
    gram = b"minimizer's gram"
    alone = [b"%c" % (97 + i) * 25 + gram + b"%c" % (110 + i) * 25 for i in range(8)]
    assert judge([batch([(int(suffix_dedup._hashes(np.frombuffer(gram, np.uint8))[0] >> np.uint64(16)), 0, i, i, 0, s, None) for i, s in enumerate(alone)])]) == set() and not built


def test_pii(spark):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    ok = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 16 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(d),
        "phone": lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15,
    }
    rng = random.Random(3)
    parts = ["a", "@", ".", "1", "25", "256", "4539578763621486", " ", "-", "+", "(", ")", "b.c", "0", "é", "٣", "192.168.1.1", "+1 (555) 010-9999", "x@y.org"]
    texts = [None, "", *("".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(300))]
    got = {r.doc_id: r for r in pii.scan(frame(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        base = {k: [m.span() for m in re.finditer(p, t or "") if ok[k](m[0])] for k, p in kinds.items()}
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(base[k]) for k in kinds)
        line = ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in base[k])
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(line.split(",")) - {""} <= set(r.spans.split(","))
    model = pii.train()
    x, y = pii.examples(1500, 77)
    sure = model.probability(x) >= 0.95
    assert sure.sum() > 50 and y[sure].mean() > 0.97
    _, more = pii.find("please call phone (212) 555-0147 or order 123456789", model)
    assert [m[0] for m in more] == ["phone"]
    assert pii.redact("a x@y.org b", [("email", 2, 9)]) == "a [email] b"
    assert pii.scan(frame(spark, [])).count() == 0


def test_boosted():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = (x[:, 0] * x[:, 1] > 0) & (x[:, 2] > -1)
    m = gbt.Boosted().fit(x[:1500], y[:1500])
    p = m.probability(x[1500:])
    assert ((p > 0.5) == y[1500:]).mean() > 0.9 and abs(p.mean() - y[1500:].mean()) < 0.1


@pytest.fixture(scope="module")
def tree_model():
    return html_extract.train()


def test_html(spark, tree_model):
    text = "Some words of a main text, with commas. " * 4
    page = (
        f'<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=/>home</a></li><li><a href=/b>b</a></li></ul></nav><!-- x -->'
        f'<div class="ad">Buy now.</div><article><h1>Head &amp; tail</h1><p><b>{text}<br><p>A&nbsp;second one &lt;here&gt;.</p></article><div class="comments"><p>I like it</p></div><footer>&copy; me</footer></body></html>'
    )
    pages = [(1, "u", page), (2, None, None), (None, "v", ""), (4, "w", "<p"), (5, "x", "no markup"), (5, "x", "<!-- open"), (6, "y", "<div>" * 2000 + "deep")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, text int")
    got = html_extract.extract_pages(df, tree_model).collect()
    first = next(r for r in got if r.page_id == 1)
    assert first.text == f"Head & tail {text.strip()} A second one <here>." and first.n_chars == len(first.text)
    assert len(got) == len(pages) and all(r.text == "" for r in got if r.page_id in (2, None, 4))
    assert html_extract.extract_pages(df.limit(0), tree_model).count() == 0


def test_html_generated(tree_model):
    x, y = html_extract.generate(30, 123)
    assert ((tree_model.probability(x) > 0.5) == y).mean() > 0.95


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = p.run(spark, "/root/testdata/sf0.001")
    step = lang_id.keep_known(docs)
    rows = [(r.doc_id, r.text) for r in step.collect()]
    norm = {}
    for i, t in sorted(rows):
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (i, t))
    rows = list(norm.values())
    comp = _components(rows)
    rows = [(i, t) for i, t in rows if comp[i][1] == i]
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    bench = [word.findall(_low(r.text)) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    win = {tuple(ws[a : a + 10]) for ws in bench for a in range(len(ws) - 9)} | {tuple(ws) for ws in bench if 0 < len(ws) < 10}
    keep = {i for i, t in rows if not any(tuple(ws[a : a + m]) in win for ws in [word.findall(_low(t))] for m in {len(w) for w in win} for a in range(len(ws) - m + 1))}
    assert {r.doc_id for r in out.collect()} == keep
    assert 4 <= len(p.STAGES) <= 5 and "pipeline" in p.queries()
