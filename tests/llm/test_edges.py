"""Odd rows, clashing columns, bounds and plain references of the training-data operators."""

import base64
import collections
import hashlib
import io
import math
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pixelmill.llm import chat, entry, exact_dedup, imatch, jaccard_join, linededup, quality, sigtree, textkern, toxicity, warc
from pixelmill.session import free_names, slot_keys


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# --- the caller's columns and rows ---

CLASH = "doc_id long, text string, source string, n_chars long, toxicity string, _toxicity string, votes string, posterior string, score string, row string, key string, gone string, split string, left string, n_lines string, _n_lines string, doc_id_ string, sha string, found string, h string, `a.b` string"


def clashing(spark, rows):
    extra = len(CLASH.split(", ")) - 4
    return spark.createDataFrame([(i, t, s, None, *(f"own {k} of {n}" for k in range(extra))) for n, (i, t, s) in enumerate(rows)], CLASH).repartition(3)


PROSE = "The people of the town came together in the evening, and they talked of the weather, the harvest and the road."
ODD = [
    (1, PROSE + " One.", "a"), (2, PROSE + " Two.", None), (2, "shared line here\nown line", "b"), (3, None, "c"), (4, "", "d"), (5, " \n\t\n", "e"), (None, "a row without an id, and words enough", "f"),
    (6, "word " * 3000, "g"), (7, "x", "h"), (7, "x", "h"), (8, "shared line here\nother", "i"), (9, "shared line here", "j"), (10, "shared line here\nlast", "k"), (11, "shared line here", "l"),
]


def same_rows(before, after, but=("text", "n_chars")):
    columns = [c for c in before.columns if c not in but]
    assert after.columns == before.columns
    all_rows = collections.Counter(tuple(r[c] for c in columns) for r in before.collect())
    kept = collections.Counter(tuple(r[c] for c in columns) for r in after.collect())
    assert not kept - all_rows
    return kept


def test_stages_keep_clashing_columns_and_odd_rows(spark, tmp_path):
    import corpus_pipeline

    docs = clashing(spark, ODD)
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        before = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = spark.createDataFrame(stage(spark, before, str(tmp_path)).collect(), before.schema)
            same_rows(before, after)
            before = after
        packed = corpus_pipeline.STAGES[-1][1](spark, before, str(tmp_path))
        assert packed.groupBy("doc_id").count().count() == before.select("doc_id").distinct().count()
    assert same_rows(docs, linededup.filter_documents(docs, 5)) == collections.Counter(tuple(r[c] for c in docs.columns if c not in ("text", "n_chars")) for r in docs.collect() if r["doc_id"] not in (9, 11))
    kept = exact_dedup.kept_documents(docs)
    assert kept.columns == docs.columns and sorted(r["text"] or "" for r in kept.collect()) == sorted({t or "" for _, t, _ in ODD})


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2)], "Score int, score_ int")
    assert free_names(df, "score", "score", "x") == ["score__", "score___", "x"]


def test_every_slot_has_a_key(spark):
    for n in (1, 336, 779):
        keys = slot_keys(spark, n)
        slots = spark.createDataFrame([(k,) for k in keys], "k int").select(F.pmod(F.hash("k"), F.lit(n)).alias("s"))
        assert [r["s"] for r in slots.collect()] == list(range(n))


# --- exact dedup ---


def test_exact_dedup_of_hot_and_null_ids(spark):
    rows = [(i if i % 100 else None, "Hot Text" if i % 2 else f"own {i}") for i in range(1, 12_001)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), budget=20_000).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len({t for _, t in rows})
    hot = [r for r in got if r["group_size"] == 6000]
    assert len(hot) == 6000 and {r["keep_id"] for r in hot} == {11_999} and sum(r["kept"] for r in hot) == 1
    assert sum(r["doc_id"] is None for r in got) == 120


# --- Jaccard join ---


def test_blocks_are_bounded_and_whole(monkeypatch):
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64) >> np.uint64(50)) for _ in range(60)]
    run = lambda some: [np.array([7 * k for k, _ in some], np.uint64), np.array([len(s) for _, s in some], np.uint32), np.array([len(s) for _, s in some], np.uint32), np.concatenate([s for _, s in some])]
    numbered = list(enumerate(sets))
    runs = [run(numbered[k : k + 5]) for k in range(0, 60, 5)]
    whole = collections.Counter((7 * k, int(t)) for k, s in numbered for t in s)
    monkeypatch.setattr(jaccard_join, "HELD", 4000)
    for by_set in (False, True):
        seen, places = collections.Counter(), {}
        for n, (digest, size, count, token) in enumerate(jaccard_join._bounded(iter(runs), by_set)):
            owner = np.repeat(digest, count)
            assert (np.repeat(size, count) == [len(sets[int(d) // 7]) for d in owner]).all()
            for d, x in zip(owner.tolist(), token.tolist()):
                seen[(d, x)] += 1
                assert places.setdefault(d if by_set else x, n) == n
        assert seen == whole and len(set(places.values())) > 3


def test_jaccard_is_the_same_in_small_blocks_and_chunks(spark):
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(6):
        base = [f"w{x}" for x in rng.integers(0, 10**9, 80)]
        for _ in range(12):
            words = list(base)
            for at in rng.choice(80, int(rng.integers(0, 6)), replace=False):
                words[at] = f"m{rng.integers(0, 10**9)}"
            texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = sorted(map(tuple, jaccard_join.components(df).collect()))
    assert want == sorted(map(tuple, jaccard_join.components(df, chunk=3).collect()))
    assert len({c for *_, c in want}) < 72


def test_cells_bring_guests_in_turns():
    rows = [(1, 0, 0, b"x" * 8), (1, 0, 1, b"y" * 8), (1, 0, 1, b"z" * 8), (1, 0, 1, b"u" * 8), (2, 0, 0, b"v" * 8)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("family", "chunk", "role", "tokens"), r)) for r in rows])
    got = [c["tokens"] for c in jaccard_join._cells(iter([batch]), ["role", "tokens"], guests=8)]
    assert got == [[b"x" * 8, b"y" * 8, b"z" * 8], [b"x" * 8, b"u" * 8], [b"v" * 8]]


def test_dual_traversal_finds_all_links():
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 1 << 62, 40, dtype=np.uint64)) for _ in range(30)]
    sets = [np.sort(b[rng.random(len(b)) < 0.95]) for b in base for _ in range(6)]
    sizes = np.array([len(s) for s in sets])
    forest = sigtree.Forest(np.arange(len(sets)))
    tree = sigtree.Tree(np.arange(len(sets)), sets, sizes, sigtree.bits_for(sets))
    list(sigtree.join(tree, tree, sets, sizes, forest))
    plain = sigtree.Forest(np.arange(len(sets)))
    for i in range(len(sets)):
        for k in range(i):
            a, b = set(sets[i].tolist()), set(sets[k].tolist())
            if 100 * len(a & b) >= 75 * len(a | b):
                plain.union(i, k)
    assert (forest.roots() == plain.roots()).all() and len(set(plain.roots().tolist())) >= 30


# --- line dedup ---


def test_line_dedup_equals_exact_counts_beyond_the_sketch(spark):
    rows = [(i, "\n".join(f"line {k}" for k in range(40) if i % (k + 20) == 0 or i < 30 + 4 * k), None, f"s{i}") for i in range(260)]
    got = by_id(linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4), 100))
    sites, first = collections.defaultdict(set), {}
    for i, t, _, s in rows:
        for at, x in enumerate(t.split("\n")):
            if x:
                sites[x].add(s)
                first.setdefault(x, (i, at))
    for i, t, *_ in rows:
        left = [x for at, x in enumerate(t.split("\n")) if not x or len(sites[x]) < 100 or first[x] == (i, at)]
        assert got[i]["text"] == "\n".join(left), i


def test_line_dedup_of_many_removed_lines(spark):
    text = "\n".join(f"line {k}" for k in range(20_000))
    rows = [(i, text + f"\nown {i}", f"s{i}") for i in range(6)]
    got = by_id(linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), 5))
    assert got[0]["_n_removed"] == 0 and all(got[i]["text"] == f"own {i}" and got[i]["_n_removed"] == 20_000 for i in range(1, 6))


# --- WARC ---


def test_warc_leaves_out_attempts_and_keeps_two_writes(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>"), (2, "v", "<p>b</p>")], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_archive(warc.plan_records(pages), path)
    warc.write_archive(warc.plan_records(pages), path)
    done = sorted(p.name for p in (tmp_path / "w").iterdir())
    assert warc.read_archive(spark, path).count() == 4 and not [n for n in done if n.startswith("_attempts")]
    stale = tmp_path / "w" / "_attempts-lost"
    stale.mkdir()
    (stale / "part-0.warc.gz").write_bytes((tmp_path / "w" / [n for n in done if n.endswith(".gz")][0]).read_bytes())
    assert warc.read_archive(spark, path).count() == 4


def record(http, body=b"", length=None):
    inside = http + body
    return b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: " + str(len(inside) if length is None else length).encode() + b"\r\n\r\n" + inside + b"\r\n\r\n"


def test_warc_of_malformed_records():
    odd = record(b"HTTP/1.1 200 OK\r\nContent-Length: 3, 3\r\n\r\n", b"abc")
    bare = record(b"no empty line ends this header")
    raw = odd + bare + record(b"HTTP/1.1 200 OK\r\n\r\n", b"x" * 9000) + record(b"")
    rows = list(warc.read_records(io.BytesIO(raw), [], True))
    assert [(r[7], r[9]) for r in rows] == [(None, b"abc"), (None, b"no empty line ends this header"), (None, b"x" * 9000), (None, b"")]
    for bad in (record(b"", length="five"), raw[:-3], b"WARC/1.1\r\nWARC-Type: response"):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(bad), [], True))


def test_warc_of_repeated_ids(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (1, "w", "<p>b</p>"), (2, "v", "<p>a</p>"), (3, None, None)], "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    digest = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(pages).collect()), key=repr)
    a, b = digest(b"<p>a</p>"), digest(b"<p>b</p>")
    assert got == sorted([(1, 8, a, "response", None), (1, 8, a, "response", None), (1, 8, b, "response", None), (2, 8, a, "revisit", 1), (3, 0, digest(b""), "response", None)], key=repr)


# --- chat ---


@pytest.mark.parametrize("system", [0, 40, 1200, 6000, 9000])
def test_windows_keep_to_the_budget(spark, system):
    rng = np.random.default_rng(system)
    rows = [(1, 0, "system", "s" * system)] if system else []
    rows += [(1, k, "user" if k % 2 else "assistant", "t" * int(n)) for k, n in enumerate(rng.integers(0, 700, 60), 1)]
    w = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    tokens = lambda n: math.ceil(n / 4) + 4
    head = tokens(system) if system else 0
    for r in w:
        turns = [tokens(len(p.split("\n", 1)[1])) for p in r["formatted"].split("<|im_end|>\n")[:-1]]
        assert sum(turns) <= chat.BUDGET or sum(turns[-1:]) + head >= chat.BUDGET and len(turns) <= 2, (sum(turns), turns)
    assert len(w) > 1


def test_roles_read_back(spark):
    roles = ["\u0000", "a\\nb", "a\nb", "\\", "\\s", "\\\\n", "<s>\\", "<|im_end|>\n", "x\u0000\\y", ""]
    rows = [(k, 0, role, "text") for k, role in enumerate(roles)]
    back = chat.read_back(chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert {r["conv_id"]: r["turns"][0]["role"] for r in back} == dict(enumerate(roles))


def test_formatted_chars_are_those_of_the_windows(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    w = chat.windows(turns)
    want = {r["conv_id"]: r["n"] for r in w.groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("n")).collect()}
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    found = {c: n for c, n in con.sql(f"select conv_id, formatted_chars from ({entry.OP9_SQL})").fetchall() if c != -7}
    assert found == want


# --- fingerprints ---

M64 = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def long_hash(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest((v & M64).to_bytes(8, "little"), seed)
    return seed


def plain_imatch(texts):
    """Fingerprints of ASCII texts by a plain reading of the method."""
    words = lambda t: {w for w in re.split(r"[\s!-/:-@\[-`{-~]+", t.lower()) if w}
    code = lambda w: xxhash.xxh64_intdigest(w.encode(), 42)
    sets = [{code(w) for w in words(t)} for t in texts]
    df = collections.Counter(x for s in sets for x in s)
    least = max(2, int(imatch.LOW * len(texts)))
    band = {x for x, n in df.items() if least <= n <= max(least, int(imatch.HIGH * len(texts)))}

    def kept(x, k):
        seeded = xxhash.xxh64_intdigest((k + 1).to_bytes(4, "little"), xxhash.xxh64_intdigest(x.to_bytes(8, "little"), 42))
        return signed(seeded) % (16 << 2 * (k // 8)) == 0

    def of(text):
        found = sorted(map(signed, (code(w) for w in words(text))))
        row = []
        for k in range(imatch.SUBSETS):
            h = 0
            for x in found:
                if x & M64 in band and kept(x & M64, k):
                    h = signed(long_hash([x, h]))
            row.append(h)
        return tuple(row) if any(row) else (signed(long_hash(found)),)

    return of


def alike(a, b):
    if a == b:
        return 1.0
    pairs = [(x, y) for x, y in zip(a, b) if x or y]
    return sum(x == y for x, y in pairs) / max(1, len(pairs)) if len(a) == len(b) else 0.0


def test_imatch_equals_a_plain_reading(spark, sf_dir):
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en'").collect() if (r["text"] or "").isascii()]
    rows.sort()
    got = by_id(imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    of = plain_imatch([t for _, t in rows])
    shown = lambda f: "".join(f"{x & M64:016x}" for x in f)
    edited, after = [], []
    for k, (i, t) in enumerate(rows):
        nxt, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        a, b, c = of(t), of(t[: len(t) - half] + nxt[:half]), of(nxt)
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (shown(a), shown(b)), i
        assert got[i]["near_edited"] == pytest.approx(alike(a, b)) and got[i]["near_next"] == pytest.approx(alike(a, c)), i
        if t != nxt and len(t) > 400:
            edited.append(got[i]["near_edited"])
            after.append(got[i]["near_next"])
    assert np.mean(edited) > np.mean(after) + 0.1


def test_imatch_without_broadcast(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120)
    want = sorted(map(tuple, imatch.fingerprints(docs).collect()))
    monkeypatch.setattr(imatch.lexicon, "__defaults__", (imatch.LOW, imatch.HIGH, "text", 0))
    assert sorted(map(tuple, imatch.fingerprints(docs).collect())) == want


# --- models ---


def test_ftrl_equals_a_plain_one():
    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(64, 6, replace=False)), int(rng.random() < 0.4)) for _ in range(200)]
    model = toxicity.Ftrl(6)
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    sign = lambda x: (x > 0) - (x < 0)

    def weight(k, l1):
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - sign(z[k]) * l1) / ((toxicity.BETA + math.sqrt(n[k])) / toxicity.ALPHA + toxicity.L2)

    for cells, y in rows:
        model.learn(cells, y)
        keys = [*cells.tolist(), "bias"]
        w = {k: weight(k, 0.0 if k == "bias" else toxicity.L1) for k in keys}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for k in keys:
            sigma = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / toxicity.ALPHA
            z[k] += g - sigma * w[k]
            n[k] += g * g
    cells, w, w0 = model.weights()
    got = dict(zip(cells.tolist(), w.tolist()))
    assert all(got.get(k, 0.0) == pytest.approx(weight(k, toxicity.L1), abs=1e-6) for k in range(64)) and w0 == pytest.approx(weight("bias", 0.0))


def test_toxicity_features_are_words_pairs_and_skips():
    one = lambda t: set(toxicity.features([t.encode()])[0].tolist())
    assert len(one("a b c d")) == 4 + 3 + 2 and one("A b") == one("a  B") and len(one("")) == 0 and len(one("x")) == 1
    assert one("a b c") & one("a x c") >= one("a") | one("c") and len(one("a b c") & one("a x c")) == 3  # two words and the pair around one


def test_samples_are_bounded_in_rows(spark):
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(300)] + [(i, "some text") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1)] * 50 + [(i, 0) for i in range(20)], "doc_id long, toxic int")
    assert toxicity.sample(docs, labels, "toxic", 5).select("rank").distinct().count() <= 5
    cells, weights, _ = toxicity.train(docs, labels, rows=5)
    assert len(cells) == len(weights)
    assert quality.train(docs, rows=5)[1].shape == ((1 << quality.BITS) + 1,)


def test_null_ids_are_neither_learned_from_nor_held_out(spark):
    docs = spark.createDataFrame([(None, "no id"), (1, "one"), (2, None)], "doc_id long, text string")
    got = by_id(toxicity.score_documents(docs, spark.createDataFrame([(None, 1), (1, 0)], "doc_id long, toxic int")))
    assert got[None]["held_out"] is False and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got.values())


def plain_votes(text):
    """The labellers' rules, word by word."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", text)
    n = max(1, len(words))
    letters = max(1, sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in text))
    chars = max(1, sum(b not in b" \t\n\v\f\r" for b in text))
    sym = set(b"#$%&*@^~=+<>|{}_\\")
    low = [w.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) for w in words]
    upper = sum(65 <= b <= 90 for b in text) / letters
    symbols = sum(b in sym for b in text) / chars
    repeats = sum(a == b for a, b in zip(low, low[1:])) / n
    stops = sum(w[-1:] in (b",", b".", b":", b";", b"?") for w in words) / n
    share = lambda f: sum(map(f, words)) / n
    votes = [
        upper > 0.4, share(lambda w: w[-1] == 33) > 0.15, symbols > 0.05, share(lambda w: w[-1] in sym) > 0.2, share(lambda w: w[-1:] == b"|") > 0.1, repeats > 0.2,
        len(words) >= 8 and len(set(low)) / n < 0.4 * min(1.0, math.sqrt(400 / n)), len(words) >= 8 and len(set(zip(low, low[1:]))) / max(len(words) - 1, 1) < 0.5, 0.02 < stops < 0.5 and upper < 0.3,
        2.5 < letters / n < 14 and symbols < 0.03 and repeats < 0.05 and len(words) > 0,
    ]
    return sum(v << i for i, v in enumerate(votes))


def test_votes_equal_plain_rules(spark, sf_dir):
    texts = [(r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += [b"", b" ", b"LOUD! LOUD! WORDS!", b"a | b | c", b"$ % & #", "é ß 漢字".encode(), b"one one one one one one one one one"]
    got = quality.votes_and_features(texts, features=False)[0].tolist()
    assert got == [plain_votes(t) for t in texts]


def test_label_model_equals_plain_em():
    counts = {0b1100000000: 700, 0b1000000000: 90, 0b0100000000: 60, 0b0000000101: 40, 0b0000010000: 25, 0b1100000001: 10, 0: 30}
    m = len(quality.LABELLERS)
    good = [0.02 if i < quality._POOR else 0.9 for i in range(m)]
    poor = [0.4 if i < quality._POOR else 0.2 for i in range(m)]
    share, p = 0.85, {}
    for _ in range(60):
        for k in counts:
            a, b = share, 1 - share
            for i in range(m):
                a *= good[i] if k >> i & 1 else 1 - good[i]
                b *= poor[i] if k >> i & 1 else 1 - poor[i]
            p[k] = a / (a + b)
        ga = sum(c * p[k] for k, c in counts.items())
        pa_ = sum(c * (1 - p[k]) for k, c in counts.items())
        clip = lambda x: min(max(x, 1e-4), 1 - 1e-4)
        good = [clip((sum(c * p[k] for k, c in counts.items() if k >> i & 1) + 1) / (ga + 2)) for i in range(m)]
        poor = [clip((sum(c * (1 - p[k]) for k, c in counts.items() if k >> i & 1) + 1) / (pa_ + 2)) for i in range(m)]
        share = min(max((ga + 1) / (ga + pa_ + 2), 0.02), 0.98)
    got = quality.fit_label_model(counts)
    assert all(got[k] == pytest.approx(p[k], rel=1e-9) for k in counts)


def test_training_rows_hold_whole_texts():
    text = " ".join(f"w{i}" for i in range(30_000)).encode()
    _, (cells,) = quality.votes_and_features([text])
    found, n = np.unique(cells, return_counts=True)
    assert n.sum() == 3 * 30_000 and len(found) <= 1 << quality.BITS
    w = quality._fit_scorer([(found, n, 1.0), (found[:5], n[:5], 0.0)], quality.BITS, 2)
    assert quality._score([cells], w)[0] > 0.5
    assert textkern.doc_words([text])[0].shape == (30_000,)
