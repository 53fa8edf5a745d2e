"""Training-data operators: brute force on small tables, nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import os
import random
import time
import tracemalloc
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from skeinflow.llm import chat, common, decontaminate, exact, langid, near, packing, quality, queries, repeats, shards, warc
from skeinflow.llm.common import components, local_rows, new_path, staged, with_group, work_dir
from skeinflow.llm.tokens import default_path, tokenizer

SF = "/root/testdata/sf0.001"
WORDS = "the of and river stone window paper garden light winter morning table silver engine harbour music letter forest summer bridge candle market copper island shadow".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", str(rng.randrange(40))]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, blanks, copies, near copies, shared passages, a long text, repeated rows, null and repeated ids."""
    rng = random.Random(4)
    texts = [prose(rng, rng.randrange(5, 120)) for _ in range(60)]
    passage = prose(rng, 50)
    out = [(k, t) for k, t in enumerate(texts)]
    out += [(100 + k, t.replace(" ", "\t\n") + " ") for k, t in enumerate(texts[:10])]
    for k in range(10):
        w = texts[k].split()
        w[rng.randrange(len(w))] = "changed"
        out.append((200 + k, " ".join(w).upper() if k % 3 == 0 else " ".join(w)))
    out += [(300 + k, prose(rng, 20) + " " + passage + " " + prose(rng, 15)) for k in range(8)]
    out += [(400, None), (401, ""), (402, " \t\n"), (403, "word"), (404, "WORD"), (405, "é \x0b漢字\x85x"), (406, prose(rng, 6000)), (407, "ab " * 60), (500, texts[3]), (500, texts[3]), (501, texts[4]), (501, texts[5]), (None, texts[6]), (None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names clash with results and helpers."""
    wide = [(d, t, "en", "src", len(t or ""), 1, 2, "x") for d, t in rows]
    return staged(spark.createDataFrame(wide, "doc_id bigint, text string, lang string, source string, n_chars bigint, node int, component_id int, score string"), "test")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def as_set(found, *columns):
    return sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str)


def test_exact(docs, rows, none):
    got = exact.exact_duplicates(docs)
    assert as_set(got, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(brute.exact(rows), key=str)
    kept = Counter(r.text_sha256 for r in got.where("kept").collect())
    assert set(kept.values()) == {1} and len(kept) == len({x[3] for x in brute.exact(rows)})
    assert exact.exact_duplicates(none).count() == 0
    assert exact.drop_exact(docs).columns == docs.columns


def test_exact_with_clashing_hashes(docs, rows, monkeypatch):
    """All chunk hashes equal: the texts alone decide."""
    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: F.lit(7).cast("bigint") if len(c) == 1 else F.hash(*c).cast("bigint"))
    assert as_set(exact.exact_duplicates(docs), "doc_id", "keep_id", "group_size", "text_sha256") == sorted(brute.exact(rows), key=str)


def test_near(docs, rows, none):
    got = near.near_duplicates(docs)
    assert as_set(got, "doc_id", "n_shingles", "component_id") == sorted(brute.near(rows), key=str)
    assert near.near_duplicates(none).count() == 0
    out = near.drop_near(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {c if c is not None else d for d, n, c in brute.near(rows)}


def test_stages_drop_rows_not_ids(spark):
    """Rows that share an id, or have none, are decided on one by one."""
    rng = random.Random(21)
    a, b = prose(rng, 40), prose(rng, 40)
    d = spark.createDataFrame([(1, a), (2, a + " x"), (2, b), (2, b), (None, a.replace(" ", "  ")), (None, b + " y"), (None, None), (None, None), (3, "")], "doc_id bigint, text string")
    assert as_set(near.drop_near(d), "doc_id", "text") == sorted([(1, a), (2, b), (None, None), (None, None), (3, "")], key=str)
    assert as_set(exact.drop_exact(d), "doc_id", "text") == sorted([(None, a.replace(" ", "  ")), (2, a + " x"), (2, b), (None, b + " y"), (3, "")], key=str)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 800).astype(np.uint64)
    other = np.concatenate([base[:700], rng.integers(0, 2**63, 100).astype(np.uint64)])
    same = (near.signature(base) == near.signature(other)).mean()
    assert abs(same - 700 / 900) < 0.15


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    edges = staged(spark.createDataFrame(pairs, "a bigint, b bigint"), "pairs")
    assert as_set(components(edges), "node", "comp") == as_set(components(edges, limit=3), "node", "comp")


def test_repeats(docs, rows, none):
    want = sorted(brute.repeats(rows, 35), key=str)
    assert as_set(repeats.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert sum(w[2] for w in want) > 0
    assert repeats.remove_repeats(none).count() == 0


def test_repeats_with_hot_anchors(docs, rows, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 1)
    assert as_set(repeats.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.repeats(rows, 35), key=str)


def test_tokens_are_the_librarys(rows):
    t = tokenizer(default_path())
    texts = [x or "" for _, x in rows] + ["a\x1cb", "<|endoftext|> x", "don't İstanbul ΣΑΣ 12 x² ª", "’re 'll ‘a’"]
    assert [np.frombuffer(t.text(x), "<u4").tolist() for x in texts] == [t.whole.encode(x, add_special_tokens=False).ids for x in texts]
    assert all(t.merge(code) == [rank] for code, rank in t.used.items())


def test_packing(docs, rows, none):
    t = tokenizer(default_path()).whole
    got = packing.pack(docs, max_len=64).toPandas()
    full = {}
    for d, x in rows:
        full.setdefault(d, []).append(t.encode(x or "", add_special_tokens=False).ids + [1])
    seen = Counter()
    for r in got.itertuples():
        d = None if r.doc_id != r.doc_id else int(r.doc_id)
        parts = [i[r.start : r.start + r.length] for i in full[d]]
        assert any(zlib.crc32(np.array(p, "<u4").tobytes()) == r.ids_crc32 for p in parts)
        seen[d] += r.length
    assert seen == Counter({d: sum(map(len, v)) for d, v in full.items()})
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    size = got.groupby("sequence_id").length.sum()
    assert size.max() <= 64 and len(size) <= -(-int(size.sum()) // 64) + 2
    assert packing.pack(none).count() == 0


def test_best_two_fit_replaces_the_smallest():
    assert packing.best_two_fit({7: 1, 2: 1, 1: 2}, 10)[0] == (1, [7, 2, 1])
    assert packing.best_two_fit({60: 1, 30: 1, 25: 1, 15: 1}, 100)[0] == (1, [60, 25, 15])
    rng = random.Random(2)
    counts = Counter(rng.randrange(1, 65) for _ in range(3000))
    used = Counter()
    for times, lengths in packing.best_two_fit(counts, 64):
        assert sum(lengths) <= 64
        for x in lengths:
            used[x] += times
    assert used == counts


def test_warc(spark, tmp_path):
    rng = random.Random(3)
    html = ["<p>" + prose(rng, 30) + "</p>" for _ in range(40)]
    pages = [(k, f"http://x/{k}", h) for k, h in enumerate(html)] + [(50, None, html[2]), (51, "http://y\r\nX: y", html[2]), (52, "u", None), (53, "u", ""), (54, "u", "\r\n\r\nWARC/1.1 é漢"), (60, "u", html[5]), (60, "u", html[5]), (None, "u", html[6]), (70, "u", "z" * 300_000)]
    df = staged(spark.createDataFrame([(*p, "c") for p in pages], "page_id bigint, url string, html string, sha string"), "pages")
    folder = f"file://{tmp_path}/a"
    index = warc.write_archives(df, folder, archive_bytes=2000)
    got = as_set(warc.read_archives(index, folder), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = []
    for k, _, h in pages:
        p = (h or "").encode()
        first = min((i for i, _, x in pages if (x or "") == (h or "") and i is not None), default=None)
        want.append((k, len(p), warc.sha1(p), "response" if k == first else "revisit", None if k == first else first))
    assert got == sorted(want, key=str)
    assert index.select("archive").distinct().count() > 1
    r = index.where("page_id = 54").collect()[0]
    assert warc.read_record(folder, r.archive, r.offset, r.length)[1].decode() == "\r\n\r\nWARC/1.1 é漢"
    assert warc.archive_round_trip(df.where("false")).count() == 0


def test_chat(spark):
    turns = [(1, s, k, r, t) for s, last in (("chosen", "good"), ("rejected", "bad")) for k, (r, t) in enumerate([("system", "s"), ("user", "u"), ("assistant", last)])]
    turns += [(2, "chosen", 0, "user", "same"), (2, "rejected", 0, "user", "same"), (3, "chosen", 0, "user", None), (None, "rejected", None, None, "x"), (1, "chosen", 2, "assistant", "good")]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "pair_id bigint, side string, turn bigint, role string, text string, part string")
    got = chat.format_pairs(df)
    by = {r.pair_id: r for r in got.collect()}
    head = "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n"
    assert by["1"].prompt == head and by["1"].chosen == "<|im_start|>assistant\ngood<|im_end|>\n" and by["1"].rejected == "<|im_start|>assistant\nbad<|im_end|>\n"
    (a, b), = by["1"].chosen_spans
    assert by["1"].chosen[a:b] == "good<|im_end|>"
    assert by["2"].prompt and not by["2"].chosen and by["3"].chosen and by[None].rejected.endswith("x<|im_end|>\n")
    assert chat.format_pairs(df.where("false")).count() == 0


def test_chat_of_long_and_hot_pairs(spark, monkeypatch):
    """One pair has a third of all turns, many of them without a number; its rows follow each other and hold every turn once."""
    monkeypatch.setattr(chat, "BROADCAST_PLACES", 0)
    rng = random.Random(17)
    turns = [(7, s, k, ("user", "assistant")[k % 2], f"t{k}" if k < 700 or s == "chosen" else f"other {k}") for s in ("chosen", "rejected") for k in range(1500)]
    turns += [(None, "chosen", None, "user", f"n{k}") for k in range(600)] + [(k, s, j, "assistant", f"{k} {j} {s if j == 3 else ''}") for k in range(20, 220) for s in ("chosen", "rejected") for j in range(5)]
    rng.shuffle(turns)
    got = chat.format_pairs(spark.createDataFrame(turns + turns[:50], "pair_id bigint, side string, turn bigint, role string, text string")).collect()
    long = sorted((r for r in got if r.pair_id == "7"), key=lambda r: r.segment)
    show = lambda k, t: f"<|im_start|>{('user', 'assistant')[k % 2]}\n{t}<|im_end|>\n"
    assert "".join(r.prompt for r in long) == "".join(show(k, f"t{k}") for k in range(700))
    assert "".join(r.chosen for r in long) == "".join(show(k, f"t{k}") for k in range(700, 1500)) and "".join(r.rejected for r in long) == "".join(show(k, f"other {k}") for k in range(700, 1500))
    assert [len(r.prompt.split("<|im_end|>")) - 1 for r in long] == [256, 256, 188, 0]
    assert [r.rejected[a:b] for r in long for a, b in r.rejected_spans] == [f"other {k}<|im_end|>" for k in range(701, 1500, 2)]
    loose = [r for r in got if r.pair_id is None]
    assert sorted("".join(r.chosen for r in loose).replace("<|im_start|>user\n", "").replace("<|im_end|>", "").split()) == sorted(f"n{k}" for k in range(600))
    assert len(got) == 4 + 3 + 200 and all(r.prompt and r.chosen and r.rejected for r in got if r.pair_id not in ("7", None))


def test_shards(spark, docs):
    store = shards.ShardStore(spark, new_path(spark, "store"), docs.schema, target_bytes=60_000, fanout=2)
    assert store.read().count() == 0
    store.append(docs.where("false"))
    assert store.read().count() == 0
    for k in range(6):
        store.append(docs.where(F.pmod(F.hash("text"), F.lit(6)) == k).coalesce(1))
    before = len(store.manifest()["shards"])
    old = store.manifest()
    store.compact()
    assert len(store.manifest()["shards"]) < before and store.manifest()["version"] > old["version"]
    assert as_set(store.read(), *docs.columns) == as_set(docs, *docs.columns) == as_set(store.read(old["version"]), *docs.columns)
    with pytest.raises(RuntimeError):
        store.commit([], {"data/none.parquet"})
    assert store.vacuum() >= before and as_set(store.read(), *docs.columns) == as_set(docs, *docs.columns)


@pytest.mark.parametrize("size", [33, 40, 50, 60])
def test_no_tier_is_stuck(spark, monkeypatch, size):
    """100 shards of a quarter to half the target, on paper: merged shards have the sum of their sizes."""
    store = shards.ShardStore(spark, new_path(spark, "store"), spark.range(1).schema, target_bytes=128)
    store.commit([{"file": f"data/{k}", "bytes": size} for k in range(100)], set())
    while due := store.runs():
        for run in due:
            store.commit([{"file": f"data/{run[0]['file'][5:]}m", "bytes": shards.size_of(run)}], {s["file"] for s in run})
    sizes = sorted(s["bytes"] for s in store.manifest()["shards"])
    assert sum(sizes) == 100 * size and all(96 <= x <= 128 for x in sizes[1:])


def test_two_writers_and_arrivals(spark):
    path = new_path(spark, "store")
    d = spark.createDataFrame([(k, f"t{k}", None if k == 3 else k % 3) for k in range(12)], "id bigint, text string, __arrival int")
    one, two = (shards.ShardStore(spark, path, d.schema, fanout=2) for _ in range(2))
    old, raced = one.manifest, []

    def late(version=None):  # the other writer commits between this one's look and its commit
        now = old(version)
        if not raced:
            raced.append(two.append(d.where("id < 5")))
        return now

    one.manifest = late
    assert one.append(d.where("id >= 5"))["version"] == 2 and raced[0]["version"] == 1
    assert as_set(two.read(), *d.columns) == as_set(d, *d.columns) and two.read(1).count() == 5
    made = two.append_arrivals(d, F.col("__arrival"))
    assert [m["version"] for m in made] == [3, 4, 5, 6] and as_set(two.read(6), "id") == sorted([(k,) for k in range(12)] * 2, key=str)
    assert two.read(3).where("id % 3 = 0").count() == 4 + 3 and two.read(6).where("__arrival is null").count() == 2
    before = two.manifest()["version"]
    assert two.compact()["version"] > before and two.read(before).count() == 24 == two.read().count()
    assert two.vacuum() > 0 and two.vacuum() == 0 and two.read().count() == 24


def test_language(spark, none):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.languages(d).toPandas().merge(d.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.doc_id.map(lambda x: zlib.crc32(str(x).encode()) % 3) == 1).all() and (held.lang == held.lang_pred).mean() > 0.97
    assert got.rejected.mean() < 0.01 and got.score.between(0, 1).all()
    model = langid.fit(d)
    odd = spark.createDataFrame([(1, "Привет как дела сегодня друзья мои"), (2, None), (3, "123 %%"), (4, "")], "doc_id bigint, text string")
    found = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert all(found[k].rejected for k in (1, 2, 3, 4)) and [found[k].lang_pred for k in (2, 3, 4)] == ["und"] * 3
    assert langid.languages(none).count() == 0
    assert langid.keep_identified(d.withColumn("score", F.lit("x"))).columns == [*d.columns, "score"]


def test_language_scores_against_brute_force(spark, monkeypatch):
    """The scores of a text are those of the mean of all its features' embeddings, however long it is and wherever the parts of a batch end; the sample doesn't depend on partitions."""
    rng = random.Random(23)
    fr = ["le", "de", "maison", "rivière", "être", "chanson", "peut", "voilà", "jardin", "était"]
    rows = [(k, " ".join(rng.choice(WORDS if k % 2 else fr) for _ in range(rng.randrange(3, 60))), "en" if k % 2 else "fr") for k in range(400)]
    rows += [(None, "the river and the stone", "en"), (7, rows[7][1], "en"), (7, rows[8][1], "fr"), (900, " ".join(rng.choice(fr) for _ in range(40_000)), None), (901, None, "en"), (902, "", "fr"), (903, "12 %", None)]
    d = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, text string, lang string, score double")
    model, again = langid.fit(d), langid.fit(d.repartition(7))
    assert model.languages == ["en", "fr"] and np.array_equal(model.parts, again.parts) and model.temperature == again.temperature
    monkeypatch.setattr(langid, "HASHED_AT_ONCE", 1000)
    got = {}
    for b in langid.predict(model)(iter([langid.pa.RecordBatch.from_pylist([{"doc_id": r[0], "text": r[1]} for r in rows])])):
        for i, r in enumerate(b.to_pylist()):
            got[len(got)] = r
    for i, (_, text, _) in enumerate(rows):
        f = [x for w in (text or "").split() for x in langid.features(w)]
        if not f:
            assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"]
            continue
        z = model.parts[f, :2].astype(np.float64).mean(axis=0) + model.bias
        p = langid.softmax(z / model.temperature)
        assert got[i]["lang_pred"] == model.languages[int(p.argmax())] and abs(got[i]["score"] - p.max()) < 1e-4
    out = langid.languages(d).collect()
    assert len(out) == len(rows) and sum(r.doc_id is None for r in out) == 1 and sum(r.doc_id == 7 for r in out) == 3 and not any(r.held_out for r in out if r.doc_id is None)
    assert np.mean([r.lang_pred == dict((x[0], x[2]) for x in rows)[r.doc_id] for r in out if r.doc_id is not None and r.doc_id < 400 and r.doc_id != 7]) > 0.97


def test_quality_against_brute_force(spark):
    rng = random.Random(5)
    t = tokenizer(default_path())
    texts = [prose(rng, rng.randrange(5, 60)) for _ in range(80)] + ["zqx jjw " * 9, None, ""]
    d = staged(spark.createDataFrame([(k, x, None if k % 7 == 0 else "en", 1) for k, x in enumerate(texts)], "doc_id bigint, text string, lang string, kept int"), "q")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)] + [(60, 0, 0), (61, 1, 1), (None, 1, 0), (1, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality.perplexities(d, labels).collect()}
    c = Counter()
    for k, x in enumerate(texts):
        if got[k].trust == 1:
            c.update(quality.pairs_of(np.frombuffer(t.text(x), "<u4")).tolist())
    kinds = Counter(p & 65_535 for p in c)

    def discounts(values):
        n = Counter(values)
        if not all(n[k] for k in (1, 2, 3, 4)):
            return [0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        return [min(max(v, 0.05), k) for k, v in ((1, 1 - 2 * y * n[2] / n[1]), (2, 2 - 3 * y * n[3] / n[2]), (3, 3 - 4 * y * n[4] / n[3]))]

    def off(v, ds):
        return ds[min(v, 3) - 1] if v else 0.0

    d1, d2 = discounts(c.values()), discounts(kinds.values())
    total, spare = Counter(), Counter()
    for p, v in c.items():
        total[p >> 16] += v
        spare[p >> 16] += off(v, d1)
    types, rest, uniform = sum(kinds.values()), sum(off(v, d2) for v in kinds.values()), 1 / (t.whole.get_vocab_size() + 1)

    def p_of(p):
        a, b = p >> 16, p & 65_535
        low = (kinds[b] - off(kinds[b], d2)) / types + rest / types * uniform
        return low if not total[a] else (c[p] - off(c[p], d1)) / total[a] + spare[a] / total[a] * low

    for k, x in enumerate(texts):
        want = -sum(np.log(p_of(p)) for p in quality.pairs_of(np.frombuffer(t.text(x or ""), "<u4")).tolist()) if x else 0.0
        assert abs(got[k].nll - want) < 1e-3 * (1 + want)
    kept = {r.doc_id: r.kept for r in quality.quality(d, labels).collect()}
    assert not kept[80] and not kept[81] and not kept[82] and sum(kept.values()) > 70
    assert quality.quality(d.where("false"), labels).count() == 0


def test_quality_of_odd_rows(spark):
    """Null and repeated ids, empty and very long texts, clashing columns, and a pair that every document has."""
    rng = random.Random(31)
    rows = [(None, "the river and the stone"), (5, prose(rng, 20)), (5, prose(rng, 30)), (5, None), (6, "the of " * 60_000), (7, ""), *((10 + k, "the of " + prose(rng, 20)) for k in range(40))]
    d = spark.createDataFrame([(*r, "en", "x", 1.5) for r in rows], "doc_id bigint, text string, lang string, pair string, logp double")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(5, 50)] + [(5, 1, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.quality(d, labels).collect()
    assert len(got) == len(rows) and sum(r.doc_id == 5 for r in got) == 3 and sum(r.doc_id is None for r in got) == 1
    assert {r.doc_id: r.n_tokens for r in got}[6] >= 120_000 and not any(r.kept for r in got if not r.n_tokens) and sum(r.kept for r in got) > 35
    assert quality.quality(d, labels.where("false")).where("kept").count() == len(rows) - 2  # without trusted rows only empty texts go


def test_quality_packs_what_a_block_repeats(spark):
    """Texts that occur again in a block, however far apart, take little more of the disk than once."""
    rng = random.Random(15)
    text = " ".join(rng.choice(WORDS) + str(rng.randrange(1000)) for _ in range(600_000))
    kinds = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "trust": pa.int32()}

    def packed(times):
        rows = pa.record_batch([pa.array(v, t) for v, t in zip((list(range(times)), [text] * times, ["en"] * times, [0] * times), kinds.values())], list(kinds))
        made = [b.to_pylist()[0] for b in quality.blocks(default_path())(iter([rows]))]
        assert [n for r in made for n in r["lengths"]] == [made[0]["lengths"][0]] * times
        assert all(len(zstandard.ZstdDecompressor().decompress(r["ids"])) == 2 * sum(r["lengths"]) for r in made)
        return len(made), sum(len(r["ids"]) for r in made), sum(r["lengths"][0] for r in made)

    (blocks, once, tokens), twice = packed(1), packed(2)
    assert blocks == twice[0] == 1 and 2 * tokens > 2 << 20 and twice[1] < 1.1 * once


def test_decontamination(spark, none):
    rng = random.Random(6)
    items = [(k, prose(rng, 30)) for k in range(12)] + [(90, "and the"), (91, None), (92, "")]
    clean = [(k, prose(rng, 150)) for k in range(300)]
    leaks = [(1000 + k, prose(rng, 60) + " " + t.upper().replace(" ", ", ") + " " + prose(rng, 60)) for k, t in items[:12]]
    leaks += [(2000 + k, " ".join(w for j, w in enumerate(t.split()) if j % 6)) for k, t in items[:12]]
    d = staged(spark.createDataFrame([(*x, 0) for x in [*clean, *leaks, (None, None), (5000, "")]], "doc_id bigint, text string, item_id int"), "d")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(d, b).collect()}
    assert {(1000 + k, k) for k in range(12)} | {(2000 + k, k) for k in range(12)} <= got
    assert not any(x < 1000 and i != 90 for x, i in got)
    assert decontaminate.find_leaks(d.where("false"), b).count() == 0 and decontaminate.find_leaks(d, b.where("false")).count() == 0


def test_decontamination_where_copies_make_the_item_common(spark):
    rng = random.Random(8)
    own = [f"w{k}" for k in range(4000)]
    item, short = ([rng.choice(own) for _ in range(n)] for n in (36, 10))
    page = [rng.choice(own) for _ in range(60)]

    def edited(words, share):
        out = list(words)
        for k in rng.sample(range(len(out)), round(share * len(out))):
            out[k] = rng.choice(own)
        return out

    def around(words):
        return " ".join(page[:30] + words + page[30:])

    docs = [(k, " ".join(rng.choice(own) for _ in range(120))) for k in range(300)]
    docs += [(1000 + k, around(item + page[:5] + short)) for k in range(100)]
    docs += [(2000 + k, around(edited(item, 0.1))) for k in range(20)] + [(3000 + k, around(edited(item[:24], 0.4) + item[24:])) for k in range(20)] + [(4000 + k, around(edited(short, 0.1))) for k in range(20)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short))], "item_id bigint, text string")).collect()}
    assert got == {(1000 + k, i) for k in range(100) for i in (1, 2)} | {(g + k, 1) for g in (2000, 3000) for k in range(20)} | {(4000 + k, 2) for k in range(20)}


def test_decontamination_of_items_that_the_dimensions_lose(spark, monkeypatch):
    rng = random.Random(9)
    pick = lambda n: [rng.choice(WORDS) + str(rng.randrange(150)) for _ in range(n)]
    items = [pick(30) for _ in range(8)]
    docs = [(k, " ".join(pick(120))) for k in range(200)]
    docs += [(1000 + k, " ".join(pick(45) + w + pick(45))) for k, w in enumerate(items)]
    docs += [(2000 + k, " ".join(pick(45) + [x for j, x in enumerate(w) if j % 5 or j > 20] + pick(45))) for k, w in enumerate(items)]
    monkeypatch.setattr(decontaminate, "randomised_svd", lambda rows, columns, rank: np.eye(columns, rank, 1 - columns, dtype=np.float32))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id bigint, text string")).collect()}
    assert got == {(g + k, k) for g in (1000, 2000) for k in range(8)}


def test_decontamination_of_long_items(spark):
    rng = random.Random(10)
    pick = lambda n: [rng.choice(WORDS) + str(rng.randrange(150)) for _ in range(n)]
    items = [pick(100 + 50 * k) for k in range(8)]
    docs = [(k, " ".join(pick(500))) for k in range(100)]
    docs += [(1000 + k, " ".join(pick(45) + w + pick(45))) for k, w in enumerate(items)]
    docs += [(2000 + k, " ".join(pick(45) + [x for j, x in enumerate(w) if j % 4 or j > len(w) * 0.7] + pick(45))) for k, w in enumerate(items)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id bigint, text string")).collect()}
    assert got == {(g + k, k) for g in (1000, 2000) for k in range(8)}


def test_decontamination_from_15_to_1000_words(spark):
    """Verbatim items of any length, one that a third of all documents have with a word left out, and ids of any type; clean rows stay although they share an id with a leak."""
    rng = random.Random(12)
    pick = lambda n: [rng.choice(WORDS) + str(rng.randrange(300)) for _ in range(n)]
    lengths = [15, 16, 25, 40, 64, 65, 120, 200, 300, 400, 600, 900, 1000]
    items = [pick(n) for n in lengths]
    wide = pick(30)
    docs = [(str(k), " ".join(pick(rng.randrange(5, 250)))) for k in range(120)]
    docs += [("leak", " ".join(pick(rng.randrange(40)) + w + pick(rng.randrange(40)))) for w in items]
    docs += [(f"wide{k}", " ".join(pick(50) + wide[: k % 30] + wide[k % 30 + 1 :] + pick(50))) for k in range(60)] + [("leak", "entirely clean words here")]
    rows = spark.createDataFrame(docs, "doc_id string, text string")
    bench = spark.createDataFrame([(f"i{k}", " ".join(w)) for k, w in enumerate([*items, wide])], "item_id string, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(rows, bench).collect()}
    brute_force = set()
    for d, text in docs:
        for k, w in enumerate([*items, wide]):
            if decontaminate.lcs(w, text.split()) >= 0.8 * len(w):
                brute_force.add((d, f"i{k}"))
    assert len(brute_force) == len(items) + 60 and got == brute_force
    left = decontaminate.drop_leaks(rows, bench)
    assert sorted(r.doc_id for r in left.collect()) == sorted([*(str(k) for k in range(120)), "leak"])


def test_decontamination_in_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 3)
    rng = random.Random(13)
    items = [prose(rng, 30) for _ in range(8)]
    docs = [(k, prose(rng, 100)) for k in range(40)] + [(100 + k, prose(rng, 20) + " " + t) for k, t in enumerate(items)] + [(100, prose(rng, 9000) + " " + items[7])] * 2
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(list(enumerate(items)), "item_id int, text string")).collect())
    assert got == sorted([*((100 + k, k) for k in range(8)), (100, 7), (100, 7)])


def test_decontamination_fits_on_every_passage(spark, monkeypatch):
    """The fit's product is that of all passages of all texts, long ones too, and of the items; not of some of them."""
    rng = random.Random(14)
    pick = lambda n: [f"w{int(rng.random() ** 2 * 900)}" for _ in range(n)]
    items = [pick(n) for n in (20, 30, 90)]
    texts = [pick(rng.randrange(200)) for _ in range(600)] + [pick(3000)]
    block = 2 * decontaminate.BLOCK
    parts = [w[k : k + block] for w in texts for k in range(0, len(w), block)]
    seen: list = []
    real = decontaminate.randomised_svd
    monkeypatch.setattr(decontaminate, "randomised_svd", lambda rows, columns, rank: seen.append((rows, columns)) or real(rows, columns, rank))
    rows = [(k, " ".join(w)) for k, w in enumerate(texts)] + [(None, None), (-1, "")]
    got = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id int, text string"))
    got.count()
    fit, columns = seen[0]
    own = sorted({t.encode() for w in items for t in w})
    number = dict(zip([f"w{k}" for k in range(900)], decontaminate.Terms(own).of([" ".join(f"w{k}" for k in range(900))])[0].tolist()))
    count = Counter()
    for w in parts:
        count.update({number[t] for t in w})
    q = np.random.default_rng(1).normal(size=(columns, 5)).astype(np.float32)
    want = np.zeros(q.shape)
    for words, times in [(w, min(1, 400 / len(parts))) for w in parts] + [(w, 16) for w in items]:
        row = Counter(number[t] for t in words)
        row = {t: n * np.log((1 + len(parts)) / (1 + count[t])) for t, n in row.items() if count[t] <= max(0.02 * len(parts), 3)}
        norm = sum(x * x for x in row.values())
        if norm:
            along = sum(x * q[t] for t, x in row.items())
            for t, x in row.items():
                want[t] += times * x * along / norm
    assert len(count) > 500 and np.abs(want).max() > 1 and np.allclose(fit.squared(q), want, rtol=1e-3, atol=1e-3)


def test_decontamination_fit_spares_the_driver(spark, monkeypatch):
    """A pass's matrices come and go as files and not through the driver's JVM, no file stays, and the driver's Python holds few copies."""
    rng = np.random.default_rng(17)
    weight = rng.random(3000).astype(np.float32)
    texts, item = [rng.integers(0, 3000, rng.integers(1, 200)).astype(np.int32) for _ in range(50)], np.array([5, 3, 5, 2999], np.int32)
    fit = decontaminate.Fit(staged(spark.createDataFrame([(w.tobytes(),) for w in texts], "words binary"), "test"), 800, [item], weight)
    q = rng.normal(size=(3000, 20)).astype(np.float32)
    want = np.zeros(q.shape)
    for w, times in [(w[k : k + 64], 0.5) for w in texts for k in range(0, len(w), 64)] + [(item, 16)]:
        a = np.bincount(w, minlength=3000) * weight
        want += times * np.outer(a, a @ q) / (a @ a)

    def no(*_):
        raise AssertionError("through the driver's JVM")

    with monkeypatch.context() as m:
        m.setattr(type(spark.sparkContext), "broadcast", no)
        for name in ("collect", "toLocalIterator", "toArrow", "toPandas"):
            m.setattr(type(fit.corpus), name, no)
        got = fit.squared(q)
    assert np.allclose(got, want, rtol=1e-3, atol=1e-3)
    assert not [x for x in os.listdir(work_dir(spark).removeprefix("file:")) if x.startswith(("fit-", "sums-"))]

    class Rows:
        def squared(self, q):
            return q[::-1].copy()

        def inner(self, q):
            return q.T @ q

    tracemalloc.start()
    try:
        decontaminate.randomised_svd(Rows(), 40_000, 200)
        assert tracemalloc.get_traced_memory()[1] < 4 * 40_000 * 216 * 4
    finally:
        tracemalloc.stop()
    q = rng.normal(size=(9000, 30)).astype(np.float32)
    q[:, 7] = q[:, 3]
    own = decontaminate.orthonormal(q.copy())
    assert np.allclose(own.T @ own, np.eye(30), atol=1e-5) and np.allclose(own @ (own.T @ q), q, atol=1e-4)


def test_decontamination_fit_spares_the_workers(tmp_path, monkeypatch):
    """A task of the fit holds its sums once, in single precision, and no copy of the matrix; what it sends on before its end is part of the whole."""
    rng = np.random.default_rng(19)
    weight, q = rng.random(20_000).astype(np.float32), rng.normal(size=(20_000, 100)).astype(np.float32)
    (q * weight[:, None]).astype(np.float32).tofile(tmp_path / "q")
    texts = rng.integers(0, 20_000, (2000, 64)).astype(np.int32)
    batches = [pa.record_batch([pa.array([w.tobytes() for w in texts[k : k + 500]], pa.binary())], ["words"]) for k in range(0, 2000, 500)]
    held = pa.total_allocated_bytes()
    turned = decontaminate.read_matrix(f"file://{tmp_path}/q", 100)
    assert turned.shape == q.shape and pa.total_allocated_bytes() - held < q.nbytes / 4
    tracemalloc.start()
    try:
        for _ in decontaminate.gram(f"file://{tmp_path}/q", 100, weight)(iter(batches)):
            pass
        assert tracemalloc.get_traced_memory()[1] < 2.5 * q.nbytes
    finally:
        tracemalloc.stop()
    want = np.zeros(q.shape)
    for w in texts:
        t, n = np.unique(w, return_counts=True)
        a = n * weight[t].astype(float)
        want[t] += np.outer(a, a @ q[t]) / (a @ a)
    for often in (1, 3, 1000):
        monkeypatch.setattr(decontaminate, "ADDED", often)
        sums = np.zeros(q.shape)
        sent = list(decontaminate.gram(f"file://{tmp_path}/q", 100, weight)(iter(batches)))
        for b in sent:
            for part, x in zip(b.column("part").to_pylist(), b.column("sums").to_pylist()):
                sums[part : part + decontaminate.PART] += np.frombuffer(x, np.float32).reshape(-1, 100)
        assert np.allclose(sums, want, rtol=1e-3, atol=1e-3) and sum(b.num_rows for b in sent) == (1 + 4 // often) * -(-20_000 // decontaminate.PART)


def test_decontamination_search_spares_the_workers(spark, monkeypatch):
    """What goes to the search's workers has no vectors: they are in a file; and few words are searched at once, with the same leaks."""
    rng = random.Random(20)
    items = [[f"w{rng.randrange(3000)}" for _ in range(30)] for _ in range(12)]
    texts = [[f"w{rng.randrange(3000)}" for _ in range(rng.randrange(150))] + (items[k % 12] if k % 5 == 0 else []) for k in range(200)]
    docs, bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id int, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id int, text string")
    sent: list = []
    real = decontaminate.searcher
    monkeypatch.setattr(decontaminate, "searcher", lambda items, *rest: sent.append(items) or real(items, *rest))
    found = []
    for most in (4, 4000, 1 << 22):
        monkeypatch.setattr(decontaminate, "SEARCHED", most)
        found.append(sorted(map(tuple, decontaminate.find_leaks(docs, bench).select("doc_id", "item_id", F.round("cosine", 4), "common", "answer").collect())))
    assert found[0] == found[1] == found[2] and {x[:2] for x in found[0]} == {(k, k % 12) for k in range(0, 200, 5)}
    assert all(x.vectors is None for x in sent) and all(x.at[1] == (int(x.active.sum()), decontaminate.RANK) for x in sent)


def test_driver_rows_start_no_workers(spark, docs, monkeypatch):
    """The driver's rows come by Arrow, also when there are none; by parallelize() every executor would start Python workers of another kind."""
    edges = staged(spark.createDataFrame([(1, 2), (2, 3), (5, 4)], "a bigint, b bigint"), "edges")

    def no(*_, **__):
        raise AssertionError("by parallelize()")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", no)
    for rows in ([], [(1, 2), (-3, 1 << 62)]):
        assert [tuple(r) for r in local_rows(spark, rows, ["a", "b"]).collect()] == rows
    assert sorted(map(tuple, components(edges).collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    assert near.drop_near(docs).count() and packing.pack(docs.where("doc_id >= 0")).count()


def test_decontamination_adds_terms_up_in_power_iterations_only(spark, monkeypatch):
    """The last pass is (A q)^T (A q) of all passages, which needs no sums by term; sums of runs are right whatever their lengths."""
    rng = np.random.default_rng(18)
    weight = rng.random(2000).astype(np.float32)
    texts, item = [rng.integers(0, 2000, rng.integers(1, 300)).astype(np.int32) for _ in range(40)], np.array([7, 8, 7], np.int32)
    fit = decontaminate.Fit(staged(spark.createDataFrame([(w.tobytes(),) for w in texts], "words binary"), "test"), 800, [item], weight)
    passes = []
    for name in ("squared", "inner"):
        real = getattr(decontaminate.Fit, name)
        monkeypatch.setattr(decontaminate.Fit, name, lambda self, q, name=name, real=real: passes.append((name, q.copy(), real(self, q))) or passes[-1][2])
    decontaminate.randomised_svd(fit, 2000, 20)
    assert [x[0] for x in passes] == ["squared"] * decontaminate.POWER + ["inner"]
    q, got = passes[-1][1:]
    want = np.zeros(got.shape)
    for w, times in [(w[k : k + 64], 0.5) for w in texts for k in range(0, len(w), 64)] + [(item, 16)]:
        a = np.bincount(w, minlength=2000) * weight
        want += times * np.outer(a @ q, a @ q) / (a @ a)
    assert np.allclose(got, want, rtol=1e-3, atol=1e-4)
    monkeypatch.setattr(decontaminate, "ADDED_AT_ONCE", 4 * 7 * 50)
    vectors, n = rng.normal(size=(90, 7)).astype(np.float32), np.concatenate([rng.integers(1, 9, 300), [1, decontaminate.LONG, decontaminate.LONG + 1, 400]])
    index, first = rng.integers(0, 90, n.sum()), np.cumsum(n) - n
    some = rng.permutation(len(n))
    assert np.allclose(decontaminate.sums_of(vectors, index, first[some], n[some]), [vectors[index[first[k] : first[k] + n[k]]].sum(axis=0) for k in some], atol=1e-4)


def test_word_hashes(monkeypatch):
    """Hashes are those of a sum over each word's bytes, whatever is hashed at once; taking them as differences of running sums is faster than adding up each word."""
    up = common.powers(common._STEP, 70_000)

    def one_by_one(a, lo, hi):
        n = hi - lo
        solid = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        values = common._BYTES[a[solid]] * up[solid - np.repeat(lo, n)]
        return common.mix(np.add.reduceat(values, np.cumsum(n) - n) + n.astype(np.uint64))

    rng = random.Random(21)
    texts = ["".join(rng.choice(" \t\n\x0bab9Z\x1cé中") for _ in range(rng.choice([0, 1, 9, 200]))) for _ in range(200)] + [None, "x" * 40_000 + " y", "z" * 70_000, "z"]
    words = [[w for w in (t or "").encode().split()] for t in texts]
    whole = np.frombuffer(b"".join(w for row in words for w in row), np.uint8)
    n = np.array([len(w) for row in words for w in row])
    want = one_by_one(whole, np.cumsum(n) - n, np.cumsum(n))
    for size in (5, 64, 1 << 15):
        with monkeypatch.context() as m:
            m.setattr(common, "SUMMED_AT_ONCE", size)
            got, first = common.column_hashes(pa.array(texts))
            assert np.array_equal(got, want) and np.diff(first).tolist() == [len(row) for row in words]
    a = np.frombuffer(" ".join(prose(rng, 60_000).split()).encode(), np.uint8)
    hi = np.append(np.flatnonzero(a == 32), len(a))
    lo = np.append(0, hi[:-1] + 1)
    assert np.array_equal(common.hashed(a, np.zeros(0, np.int64))[0], one_by_one(a, lo, hi))

    def seconds(f):
        took = []
        for _ in range(7):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    assert seconds(lambda: common.hashed(a, np.zeros(0, np.int64))) < 0.8 * seconds(lambda: one_by_one(a, lo, hi))


def test_lcs():
    rng = random.Random(7)
    for _ in range(50):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.lcs(a, b) == table[-1][-1]


def test_with_group(spark):
    d = spark.createDataFrame([(k % 3, k) for k in range(50)], "g int, x int")
    got = with_group(d, ["g"], [F.max("x").alias("m")], [F.max("m").alias("m")], by="x")
    assert {(r.g, r.m) for r in got.collect()} == {(0, 48), (1, 49), (2, 47)} and got.count() == 50


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, name):
    from compare import compare

    said, ok = compare(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)
    assert ok, said


def test_pipeline_stage_fits_on_every_row(spark, tmp_path, monkeypatch):
    """The pipeline's decontamination gives the fit all words of all rows that it gets."""
    import corpus_pipeline

    rng = random.Random(16)
    texts = [" ".join(rng.choice(WORDS) + str(rng.randrange(90)) for _ in range(rng.randrange(1, 150))) for _ in range(1500)]
    item = " ".join(rng.choice(WORDS) + str(rng.randrange(90)) for _ in range(30))
    docs = spark.createDataFrame([(k % 900, t, "en") for k, t in enumerate(texts)] + [(1, f"before {item} after", "en"), (2, None, "en")], "doc_id int, text string, lang string")
    spark.createDataFrame([(1, item)], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = []
    monkeypatch.setattr(decontaminate, "randomised_svd", lambda rows, columns, rank: seen.append(rows) or np.eye(columns, rank, dtype=np.float32))
    left = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert sorted(r.text for r in left.where("text is not null").collect()) == sorted(texts)
    words = sum(len(t.split()) for t in texts) + len(item.split()) + 2
    assert seen[0].corpus.agg(F.sum(F.length("words"))).collect()[0][0] == 4 * words


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline as p

    d = spark.read.parquet(f"{SF}/documents.parquet")
    now = [(r.doc_id, r.text) for r in d.collect()]
    frame = d
    for name, stage in p.STAGES[:-1]:
        frame = staged(stage(spark, frame, SF), name)
        assert frame.columns == d.columns
        have = {r.doc_id for r in frame.collect()}
        if name == "exact_dedup":
            assert have == {k for _, k, _, _ in brute.exact(now)}
        elif name == "near_dedup":
            assert have == {c for _, _, c in brute.near([(i, x) for i, x in now])} | {i for i, n, c in brute.near(now) if c is None}
        else:
            assert len(have) > 0.9 * len(now)
        now = [(r.doc_id, r.text) for r in frame.collect()]
    assert set(r.doc_id for r in p.STAGES[-1][1](spark, frame, SF).collect()) == {i for i, _ in now}


def test_pipeline_of_odd_rows(spark, rows, docs, tmp_path):
    """Nulls, repeated ids and rows, clashing columns, and no rows at all, through run()."""
    import corpus_pipeline as p

    rng = random.Random(41)
    leak = prose(rng, 30)
    more = spark.createDataFrame([(9000, prose(rng, 40) + " " + leak, "en", "src", 1, 1, 2, "x"), (9000, prose(rng, 50), "en", "src", 1, 1, 2, "x")], docs.schema)
    for name, frame in (("some", docs.unionByName(more)), ("none", docs.where("false"))):
        frame.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, leak), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert p.run(spark, f"{tmp_path}/none").count() == 0
    now = frame = spark.read.parquet(f"{tmp_path}/some/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in now.collect()]
        now = staged(stage(spark, now, f"{tmp_path}/some"), name)
        after = sorted(((r.doc_id, r.text) for r in now.collect()), key=str)
        assert now.columns == frame.columns
        if name == "exact_dedup":
            groups = {}
            for d, t in before:
                key = "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
                groups.setdefault(key, []).append((-len(t or ""), d is None, d or 0, (d, t)))
            assert after == sorted((min(g, key=lambda x: x[:3])[3] for g in groups.values()), key=str)
        elif name == "near_dedup":
            components = {}
            for (d, t), (_, _, c) in zip(before, brute.near([(k, t) for k, (_, t) in enumerate(before)])):
                components.setdefault(c, []).append((d is None, d or 0, (d, t)))
            assert len(after) == len(components) and all((r[0] is None, r[0] or 0) in [min(x[:2] for x in g) for g in components.values()] for r in after)
        elif name == "decontamination":
            assert after == sorted((r for r in before if leak not in (r[1] or "")), key=str) and len(after) == len(before) - 1
    packed = p.run(spark, f"{tmp_path}/some").collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(d for d, _ in after) and any(r.doc_id == 9000 for r in packed)
