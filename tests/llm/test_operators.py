"""The training-data operators against brute force, and their edge cases."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.llm import bpe, chat, entry, exact_dedup, imatch, jaccard_join, linededup, packing, quality, sigtree, textkern, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, score double, _key string"
LONG = " ".join(f"word{i}" for i in range(40_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog again and again."), (2, "the QUICK brown fox jumps over the lazy dog again and again."), (3, None), (4, ""), (5, "  \n\t "),
    (6, "one two three"), (7, "One Two Three"), (8, LONG), (9, LONG + " end"), (None, "a row without an id, five words and more"), (11, "É ß Straße naïve 漢字 🙂\n\nline\nline"), (11, "É ß Straße naïve 漢字 🙂\n\nline\nline"), (12, "x"), (13, "word " * 300),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if k % 3 else "en", None if k % 4 == 0 else f"s{k % 5}", None, "x", None, "k") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- exact dedup ---


def test_exact_dedup(spark, docs):
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(TEXTS)
    groups = collections.defaultdict(list)
    for i, t in TEXTS:
        groups[re.sub("[A-Z]", lambda m: m[0].lower(), t or "")].append(i)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = collections.Counter()
    for r in got:
        ids = by_sha[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept.values()) == {1}
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_grace_spills_and_recurses():
    texts = [f"text number {i % 700} ".encode() * 20 for i in range(3000)]
    import xxhash

    got = {t: loads for _, t, loads in exact_dedup.grace(((xxhash.xxh3_64_intdigest(t), t, i) for i, t in enumerate(texts)), budget=4000)}
    want = collections.defaultdict(list)
    for i, t in enumerate(texts):
        want[t].append(i)
    assert got == want
    same = list(exact_dedup.grace(((5, bytes([i]), i) for i in range(200)), budget=300))  # equal hashes, different content
    assert sorted(t for _, t, _ in same) == [bytes([i]) for i in range(200)]


# --- Jaccard join ---


def brute_components(rows):
    word = re.compile(rb"[^\x20\x09-\x0D]+")
    sets = []
    for i, t in rows:
        w = word.findall((t or "").encode().lower())
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and 100 * len(x & y) >= 75 * len(x | y):
                i, k = find(a), find(b)
                parent[max(i, k)] = min(i, k)
    low = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, len(s), low.get(find(k))) for k, (i, s) in enumerate(sets)), key=repr)


def family(rng, n, size, share):
    base = [f"w{x}" for x in rng.integers(0, 10**9, size)]
    out = []
    for _ in range(n):
        words = list(base)
        for at in rng.choice(size, int(size * share * rng.random()), replace=False):
            words[at] = f"m{rng.integers(0, 10**9)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("chunk", [2048, 4])
def test_jaccard_equals_brute_force(spark, docs, chunk):
    rng = np.random.default_rng(chunk)
    texts = [t for n, size, share in ((30, 60, 0.06), (12, 200, 0.05), (9, 8, 0.2), (5, 400, 0.1)) for t in family(rng, n, size, share)]
    texts += [" ".join(f"w{x}" for x in rng.integers(0, 10**9, 30)) + " the same passage that many documents share in the end" for _ in range(25)]
    rows = [(100 + i, t) for i, t in enumerate(texts)]
    df = docs.select("doc_id", "text", "h").union(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, h string")).repartition(5)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.components(df, chunk=chunk).collect()), key=repr)
    assert got == brute_components(TEXTS + rows)
    left = jaccard_join.one_of_each(df)
    assert left.columns == df.columns


def test_one_row_of_each_component(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue white black grey pink")
    rows = [(1, a, "x"), (2, a, "y"), (2, b, "own"), (3, c, "p"), (3, c, "q"), (None, "no id here but some words", "m"), (None, "no id here but some words", "n"), (None, c, "z"), (4, None, "s"), (4, "", "t"), (None, None, "u"), (5, "a clear row with its own words", "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string").repartition(3)
    left = jaccard_join.one_of_each(df)
    assert left.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr)
    assert got == sorted([(1, a), (2, b), (3, c), (None, "no id here but some words"), (4, None), (4, ""), (None, None), (5, "a clear row with its own words")], key=repr)
    plain = df.where("doc_id in (1, 5)").union(spark.createDataFrame([(6, a, "w")], df.schema))
    assert sorted(r["doc_id"] for r in jaccard_join.one_of_each(plain).collect()) == [1, 5]


def test_shares_of_two_slots_in_one_task():
    import pyarrow as pa

    parts = [np.array([1, 2], np.uint64), np.array([1 << 63, 1 << 63 | 5, 1 << 63 | 9], np.uint64)]
    rows = [{"slot": 7, "digests": np.array([d], "<u8").tobytes(), "sizes": np.array([5], "<u4").tobytes(), "counts": np.array([len(t)], "<u4").tobytes(), "tokens": t.tobytes()} for t in parts for d in (11, 12, 11)]
    batch = pa.RecordBatch.from_pylist([{"ids": None} | r for r in rows], jaccard_join._PACKED)
    shares = [r for b in jaccard_join._share(iter([batch]), [7, 7]) for r in b.to_pylist()]
    got = collections.Counter()
    for r in shares:
        for d, n in zip(np.frombuffer(r["digests"], "<u8").tolist(), np.frombuffer(r["counts"], "<u4").tolist()):
            got[d] += n
    assert got == {11: 5, 12: 5} and {x for r in shares for x in np.frombuffer(r["dfs"], "<u4").tolist()} == {2}


def test_jaccard_empty(spark):
    assert jaccard_join.components(empty(spark)).count() == 0


def test_threshold_is_exact():
    x = np.arange(7, dtype=np.uint64)
    assert sigtree.linked(x[:6], x[:6], 7, 7)  # 6 of 8
    assert not sigtree.linked(x[:5], x[:5], 7, 7)
    assert sigtree.linked(x[:3], x[:4], 3, 4)  # 3 of 4


def test_shingles_do_not_cross_texts_or_segments(monkeypatch):
    texts = [b"a b c d e f", b"b c d e f g", b"", b"c d", LONG.encode()]
    whole = [s.tolist() for s in textkern.shingle_sets(texts)]
    monkeypatch.setattr(textkern.segments, "__defaults__", (64,))
    assert [s.tolist() for s in textkern.shingle_sets(texts)] == whole
    assert [textkern.shingle_sets([t])[0].tolist() for t in texts] == whole
    assert [len(s) for s in whole] == [2, 2, 0, 1, 39_996]


# --- tokenizers ---


def test_bpe_equals_tiktoken(spark, docs):
    import tiktoken

    ranks = bpe.read_ranks(entry.BYTE_RANKS)
    enc = tiktoken.Encoding("own", pat_str=entry.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = docs.withColumn("ids", F.lit("clash"))
    got = bpe.decode(bpe.encode(df, entry.BYTE_RANKS, entry.PATTERN, spans=True), entry.BYTE_RANKS).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == enc.encode_ordinary(r["text"] or "") and r["n_tokens"] == len(ids)
        assert bytes(r["decoded"]) == (r["text"] or "").encode() and r["decoded_text"] == (r["text"] or "")
        assert all(0 <= a < b <= len(r["text"]) for a, b in zip(r["char_start"], r["char_end"]))
    assert bpe.encode(empty(spark), entry.BYTE_RANKS, entry.PATTERN).count() == 0


def test_split_characters_decode_to_replacement():
    ids = np.array([bpe.read_ranks(entry.BYTE_RANKS)[bytes([b])] for b in "é".encode()], np.uint32)
    assert bpe.decode_ids(ids, entry.BYTE_RANKS).tobytes() == "é".encode()
    start, end = bpe.offsets(ids, entry.BYTE_RANKS)
    assert start.tolist() == [0, 0] and end.tolist() == [1, 1]
    assert bpe.decode_ids(ids[:1], entry.BYTE_RANKS).tobytes().decode("utf-8", "replace") == "�"
    with pytest.raises(ValueError):
        bpe.decode_ids(np.array([10**6], np.uint32), entry.BYTE_RANKS)


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(entry.WORD_JSON)
    tok.encode_special_tokens = True
    pieces = packing.pack(docs, entry.WORD_JSON).collect()
    want = collections.Counter()
    for i, t in TEXTS:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        at = 0
        for k in packing.piece_lengths(len(ids)):
            want[(i, at, k, len(ids), np.array(ids[at : at + k], "<u4").tobytes())] += 1
            at += k
        assert at == len(ids)
    assert collections.Counter((r["doc_id"], r["start"], r["length"], r["doc_tokens"], bytes(r["ids"])) for r in pieces) == want
    assert len({r["sequence_id"] for r in pieces}) == len(pieces) and {r["offset"] for r in pieces} == {0}
    batches = packing.equal_length_batches(packing.pack(docs, entry.WORD_JSON), 4096).collect()
    assert sum(len(r["sequence_ids"]) for r in batches) == len(pieces)
    assert all(len(r["ids"]) == 4 * len(r["sequence_ids"]) << r["bucket"] for r in batches)
    assert packing.pack(empty(spark), entry.WORD_JSON).count() == 0


def test_packing_of_added_tokens(spark):
    from tokenizers import Tokenizer

    texts = {1: "a <|endoftext|> b", 2: "plain text, as ever", 3: "<|startoftext|><|endoftext|>", 4: "<|ENDOFTEXT|> is text", 5: "x" * 3000 + "<|endoftext|>é", 6: ""}
    tok = Tokenizer.from_file(entry.WORD_JSON)
    pieces = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(1), entry.WORD_JSON).collect()
    for i, text in texts.items():
        own = sorted((r["start"], bytes(r["ids"])) for r in pieces if r["doc_id"] == i)
        assert np.frombuffer(b"".join(x for _, x in own), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids + [1], i
    assert 49407 in np.frombuffer(b"".join(bytes(r["ids"]) for r in pieces if r["doc_id"] == 1), "<u4")


def test_piece_lengths():
    for n in (1, 2, 3, 2047, 2048, 2049, 9000):
        k = packing.piece_lengths(n)
        assert sum(k) == n and all(x & (x - 1) == 0 and x <= 2048 for x in k)


# --- line dedup ---


def test_line_dedup(spark):
    rows = [(i, f"own {i}\nboiler plate\n\n  ", "en", f"s{i % 6}", 0, "h", 1.0, "k") for i in range(12)]
    rows += [(20, "boiler plate", "en", "s1", 0, "h", 1.0, "k"), (21, "twice\ntwice\nthrice", "en", None, 0, "h", 1.0, "k"), (22, None, "en", "s2", 0, "h", 1.0, "k"), (None, "boiler plate\nrest", "en", "s3", 0, "h", 1.0, "k")]
    got = {r["doc_id"]: r for r in linededup.dedup_lines(spark.createDataFrame(rows, DOCS), 5).collect()}
    assert got[None]["text"] == "boiler plate\nrest"  # the first occurrence stays
    assert got[0]["text"] == "own 0\n\n  " and got[0]["_n_lines"] == 2 and got[0]["_n_removed"] == 1
    assert got[20]["text"] == "" and got[21]["_n_removed"] == 0 and got[22]["text"] is None
    out = linededup.filter_documents(spark.createDataFrame(rows, DOCS), 5)
    assert out.columns == DOCS.replace(" long", "").replace(" string", "").replace(" double", "").split(", ")
    assert {r["doc_id"] for r in out.collect()} == {r[0] for r in rows} - {20}
    assert linededup.dedup_lines(empty(spark)).count() == 0


# --- WARC ---


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "u3", "<p>a</p>"), (1, "u1", "<p>a</p>"), (2, None, None), (4, "u\r\n4", ""), (5, "u5", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" + "é" * 3000), (7, "u7", "x" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("size", F.lit(1)).repartition(3)
    got = {r["page_id"]: r for r in warc.archive_pages(pages).collect()}
    import base64

    for i, _, html in rows:
        raw = (html or "").encode()
        assert got[i]["payload_bytes"] == len(raw) and got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert {i for i in got if got[i]["record_type"] == "revisit"} == {3, 4} and got[3]["refers_to"] == 1 and got[4]["refers_to"] == 2
    path = f"file://{tmp_path}/w"
    warc.write_archive(warc.plan_records(pages), path)
    back = warc.read_archive(spark, path)
    assert back.where("record_type = 'revisit'").count() == 2 and back.where("record_id = '<urn:page:5>'").count() == 1
    assert back.where("refers_to is not null").count() == 2 and back.select("target_uri").where("record_type in ('response')").count() == 4
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_warc_keeps_the_payload_of_a_page_without_id(spark):
    import base64

    pages = spark.createDataFrame([(1, "u1", "<p>a</p>"), (None, "u2", "<p>a</p>"), (None, "u3", "<p>b</p>"), (4, "u4", "<p>a</p>")], "page_id long, url string, html string")
    digest = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(pages).collect()), key=repr)
    a, b = digest(b"<p>a</p>"), digest(b"<p>b</p>")
    assert got == sorted([(1, 8, a, "response", None), (None, 8, a, "response", None), (None, 8, b, "response", None), (4, 8, a, "revisit", 1)], key=repr)


def test_warc_plain_and_pushdown():
    import io

    raw = b"".join(warc.record_bytes({"record_type": t, "record_id": str(i), "payload": b"p" * i}) for i, t in enumerate(["response", "revisit", "response"]))
    rows = list(warc.read_records(io.BytesIO(raw), [("record_type", ["response"])], True))
    assert [r[1] for r in rows] == ["0", "2"] and rows[1][-1] == b"pp"
    assert [r[-1] for r in warc.read_records(io.BytesIO(raw), [], False)] == [None] * 3
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(raw[:-8]), [], True))


# --- chat ---

TURNS = "conv_id long, turn long, role string, text string, window int"


def chat_rows():
    rng = np.random.default_rng(2)
    rows = [(-7, 0, "user", "</s>[INST] ok [/INST]", 0), (-7, 1, "assistant", "</s>[INST] ok [/INST]", 0), (1, None, None, None, 0), (2, 0, "system", "be brief", 0)]
    odd = ["<|im_end|>", "<\\|im_end|>", "[\\\\INST]", "a\\b", "<<SYS>>", "<<s>", "\n", "é🙂", "<|im_start|>user\nhi<|im_end|>\n", "[", "<"]
    for c in range(3, 9):
        rows.append((c, 0, "system", "system " + odd[c], 0))
        for k in range(1, 30):
            rows.append((c, k, "user" if k % 2 else "assistant", "".join(rng.choice(odd, rng.integers(0, 40))), 0))
    rows += [(9, 1, "assistant", "same", 0), (9, 1, "assistant", "same", 0), (9, 2, "tool\n\\x", "t", 0), (9, 3, "assistant", "y" * 20_000, 0)]
    return rows


@pytest.mark.parametrize("budget,reserve", [(2048, 512), (120, 40)])
def test_chat_reads_back(spark, budget, reserve):
    rows = chat_rows()
    w = chat.windows(spark.createDataFrame(rows, TURNS), budget, reserve).cache()
    got = {r["conv_id"]: r for r in chat.digests(w).collect()}
    convs = collections.defaultdict(list)
    for c, turn, role, text, _ in rows:
        convs[c].append((-1 if turn is None else turn, role or "", text or ""))
    for c, turns in convs.items():
        turns.sort()
        listing = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), hashlib.sha256(listing.encode()).hexdigest()), c
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest()), c
    assert set(got) == set(convs)
    if budget == 120:
        some = w.where("conv_id = 3 and window > 1").collect()
        assert len(some) > 3 and all(r["formatted"].startswith("<|im_start|>system\n") and r["n_repeated"] >= 1 for r in some)
    assert chat.windows(spark.createDataFrame([], TURNS)).count() == 0


def test_chat_over_driver_table(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    want = {r[0]: r[1:] for r in con.sql(entry.OP9_SQL).fetchall()}
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in entry.op9_chat(spark, sf_dir).collect()}
    assert got == want


# --- fingerprints ---


def test_imatch(spark, docs):
    rows = [(i, t) for i, t in TEXTS if i is not None]
    unique = [(i, t) for k, (i, t) in enumerate(rows) if i not in [x for x, _ in rows[:k]]]
    got = {r["doc_id"]: r for r in imatch.fingerprints(spark.createDataFrame([(i, t, 1) for i, t in unique], "doc_id long, text string, bucket int")).collect()}
    assert set(got) == {i for i, _ in unique}
    for k, (i, t) in enumerate(sorted(unique)):
        t, nxt = t or "", sorted(unique)[(k + 1) % len(unique)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest(), i
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
        if edited == t:
            assert got[i]["fingerprint"] == got[i]["edited_fingerprint"] and got[i]["near_edited"] == 1
    assert got[3]["fingerprint"] == got[4]["fingerprint"] and got[3]["near_next"] == 1
    assert imatch.fingerprints(docs).count() == len(TEXTS)  # repeated and null ids
    assert imatch.fingerprints(empty(spark)).count() == 0


def test_imatch_native_plan(spark, docs):
    plan = imatch.fingerprints(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- models ---


def labelled(spark, n=400):
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(n):
        w = list(rng.choice(words, 40))
        toxic = i % 4 == 0
        if toxic:
            for k in rng.choice(40, 4, replace=False):
                w[k] = str(rng.choice(["vile", "scum", "idiot"]))
        rows.append((i, " ".join(w) + ".", int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_held_out(spark, docs):
    both = labelled(spark)
    labels = both.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score_documents(both.select("doc_id", "text"), labels).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in both.collect()}
    held = [i for i in got if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.97
    assert toxicity.score_documents(docs, labels).count() == len(TEXTS)
    assert toxicity.score_documents(empty(spark), labels).count() == 0
    none = toxicity.score_documents(docs, labels.limit(0)).collect()
    assert all(r["score"] < 0.01 and r["predicted"] == 0 for r in none)
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_ftrl_is_sparse():
    m = toxicity.Ftrl(10)
    rng = np.random.default_rng(0)
    for _ in range(3000):
        y = int(rng.random() < 0.5)
        m.learn(np.sort(rng.choice(np.arange(1, 1000), 20, replace=False)) if not y else np.append(0, np.sort(rng.choice(np.arange(1, 1000), 20, replace=False))), y)
    cells, w, _ = m.weights()
    assert w[cells == 0][0] > 1 and len(cells) < 400


def test_quality(spark, docs):
    rng = np.random.default_rng(6)
    words = [f"wo{'abcdefghij'[i % 10]}rd{'klmnop'[i % 6]}" for i in range(60)]
    good = [", ".join(" ".join(rng.choice(words, 8)) for _ in range(6)) + "." for _ in range(150)]
    poor = [g.upper().replace(" ", "!! ") for g in good[:20]] + [g.replace(" ", "$$$ ").replace(",", "%%%") for g in good[20:40]] + [" ".join(x for x in g.split() for _ in range(8)) for g in good[40:60]] + [g.replace(" ", " | ") for g in good[60:80]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + poor)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] >= quality.KEEP for r in quality.classify(df).collect()}
    assert all(got[i] for i in range(150)) and not any(got[i] for i in range(150, 230))
    assert quality.classify(docs).count() == len(TEXTS) and quality.classify(empty(spark)).count() == 0
    assert quality.keep_good(docs).columns == docs.columns


def test_label_model_learns_rates():
    rng = np.random.default_rng(7)
    counts = collections.Counter()
    for _ in range(4000):
        bad = rng.random() < 0.15
        fired = rng.random(10) < (np.array([0.5] * 8 + [0.1, 0.1]) if bad else np.array([0.01] * 8 + [0.95, 0.95]))
        counts[int((fired << np.arange(10)).sum())] += 1
    p = quality.fit_label_model(counts)
    assert p[0b1100000000] > 0.99 and p[0b0000000111] < 0.01


# --- pipeline ---


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "line_dedup", "near_duplicates", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, sizes = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, before, sf_dir).collect(), before.schema)
        assert after.columns == docs.columns
        assert {r["doc_id"] for r in after.select("doc_id").collect()} <= {r["doc_id"] for r in before.select("doc_id").collect()}
        sizes.append(after.count())
        before = after
    assert docs.count() >= sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0
    rows = [(i, t) for i, t in before.select("doc_id", "text").collect()]
    assert all(i == c for i, _, c in brute_components(rows))  # one of each group
    packed = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir)
    total = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert len(total) == sizes[-1] and all(r["n"] == r["m"] for r in total)
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    want = con.sql(entry.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    at = [want.columns.index(c) for c in order]
    assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
