"""Joins, removal of repeats, decontamination, shards, URLs and the pipeline against plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import EDGES, ITEM_WORD, SF, WORD, key, lower, rows_of
from pyspark.sql import functions as F


def _groups(rows, size, percent):
    """Smallest id of every row's component, by comparing all pairs that share a gram."""
    grams = []
    for _, text in rows:
        w = re.findall(WORD, lower(text))
        grams.append(set(zip(*(w[k:] for k in range(size)), strict=False)) if len(w) >= size else {tuple(w)} if w else set())
    lists, up = {}, list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, own in enumerate(grams):
        shared = Counter(j for g in own for j in lists.get(g, ()))
        for j, n in shared.items():
            if 100 * n >= percent * (len(own) + len(grams[j]) - n):
                up[max(top(i), top(j))] = min(top(i), top(j))
        for g in own:
            lists.setdefault(g, []).append(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(doc, least.get(top(i), doc))
    return [(doc, len(grams[i]), least.get(top(i)) if grams[i] else doc) for i, (doc, _) in enumerate(rows)]


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_similar_groups(docs, texts, size, percent):
    from archtrail.llm.jaccard_join import similar_groups

    assert sorted(rows_of(similar_groups(docs, size=size, percent=percent)), key=key) == sorted(_groups(texts, size, percent), key=key)


def _near_copies(spark, n, words, seed):
    """Texts of one family in which each has a few words changed, and short ones."""
    rng = np.random.default_rng(seed)
    base = [f"w{rng.integers(500)}" for _ in range(words)]
    rows = []
    for k in range(n):
        own = list(base)
        for _ in range(int(rng.integers(0, 5))):
            own[int(rng.integers(words))] = f"x{rng.integers(9)}"
        rows.append((k, " ".join(own)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("words", [9, 60])
def test_large_groups_of_near_copies(spark, words):
    from archtrail.llm.jaccard_join import similar_groups

    rows, docs = _near_copies(spark, 300, words, words)  # lists beyond SHORT_LIST: worked on in blocks
    assert sorted(rows_of(similar_groups(docs, size=2, percent=80))) == sorted(_groups(rows, 2, 80))


def test_hot_lists_are_dealt_in_blocks(spark, monkeypatch):
    from archtrail.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "HOT_COUNT", 20)
    rows, docs = _near_copies(spark, 120, 40, 7)
    assert sorted(rows_of(jaccard_join.similar_groups(docs, size=2, percent=80))) == sorted(_groups(rows, 2, 80))


def test_subsets_and_sketches_lose_nothing():
    from archtrail.llm.jaccard_join import _subset_keys, light_limit, most_shared, sketch

    rng = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(rng.integers(0, 30, rng.integers(3, 14)).astype(np.uint64))
        b = np.unique(np.concatenate([a, rng.integers(0, 30, 2).astype(np.uint64)])[rng.integers(0, 2) :])
        shared, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        # a subset meant for two sizes ties sets of those two sizes
        keys = [{k for k, equal in zip(*_subset_keys(x, 70), strict=True) if equal or len(a) != len(b)} for x in (a, b)]
        assert np.array_equal(a, b) or bool(keys[0] & keys[1]) == (100 * shared >= 70 * union)
        assert most_shared(sketch(a), sketch(b)) >= shared
    assert light_limit(85, 1.0) <= light_limit(85, 50.0)


def test_components_of_a_long_path_need_few_rounds(spark, monkeypatch):
    from archtrail.llm import components as c

    rounds = []
    monkeypatch.setattr(c, "written", lambda frame, keep=c.written: rounds.append(1) or keep(frame))
    path = spark.range(3000).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b"))
    assert c.components(path).select("root").distinct().count() == 1
    assert len(rounds) < 40  # two tables a round


def test_remove_repeats(docs, texts):
    from archtrail.llm.suffix_dedup import remove_repeats

    first = {}
    for doc, text in texts:
        body = (text or "").encode()
        if doc is not None:
            for s in {body[p : p + 50] for p in range(len(body) - 49)}:
                first[s] = min(doc, first.get(s, doc))
    want = []
    for doc, text in texts:
        body, gone = (text or "").encode(), set()
        for p in range(len(body) - 49 if doc is not None else 0):
            if first[body[p : p + 50]] < doc:
                gone.update(range(p, p + 50))
        spans = [[p, p] for p in sorted(gone) if p - 1 not in gone]
        for s in spans:
            while s[1] in gone:
                s[1] += 1
        kept = bytes(b for p, b in enumerate(body) if p not in gone)
        want.append((doc, len(body), [tuple(s) for s in spans], hashlib.sha256(kept).hexdigest()))
    got = [(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], hashlib.sha256(r.kept).hexdigest()) for r in remove_repeats(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_remove_repeats_carries_columns(spark):
    from archtrail.llm.suffix_dedup import remove_repeats

    docs = spark.createDataFrame([(k, "passage of text that is the same " * 3, f"s{k}", k % 2 == 0) for k in range(5)], "doc_id long, text string, source string, kept boolean")
    got = {r.doc_id: (r.row.source, r.row.kept, len(r.kept)) for r in remove_repeats(docs, carry=["source", "kept"]).collect()}
    assert got == {0: ("s0", True, 99)} | {k: (f"s{k}", k % 2 == 0, 0) for k in range(1, 5)}


def test_multikey_sort_orders_suffixes():
    from archtrail.llm.suffix_dedup import multikey_sort, token_at

    data = np.frombuffer(b"banana bandana banana bandana " * 3, np.uint8)
    at = np.arange(len(data) - 24)
    order, fresh = multikey_sort(len(at), [lambda rows, k=k: token_at(data, at[rows] + k) for k in (0, 8, 16)])
    strings = [data[p : p + 24].tobytes() for p in at[order]]
    assert strings == sorted(strings)
    assert fresh.tolist() == [k == 0 or strings[k] != strings[k - 1] for k in range(len(strings))]


def _items(spark):
    own = [(1, EDGES[7][1]), (1, EDGES[7][1]), (2, "two two"), (3, None), (4, ""), (None, "one"), (5, "a b c d e f g h i j k l m n"), (6, "?!")]
    return spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame(own, "item_id long, text string")).withColumn("words", F.lit(1))


def _plain_contamination(texts, items, size=13):
    windows = {}
    for item, text in items:
        w = re.findall(ITEM_WORD, lower(text))
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(n, {}).setdefault(tuple(w[k : k + n]), set()).add(None if item is None else str(item))
    out = []
    for doc, text in texts:
        w, hit, found = re.findall(ITEM_WORD, lower(text)), set(), set()
        for n, of in windows.items():
            for k in range(len(w) - n + 1):
                if (got := of.get(tuple(w[k : k + n]))) is not None:
                    found |= got
                    hit |= set(range(k, k + n))
        out.append((doc, len(w), len(hit), sorted(x for x in found if x is not None), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_contamination(spark, docs, texts):
    from archtrail.llm.decontaminate import contamination

    items = _items(spark)
    got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in contamination(docs, items).collect()]
    assert sorted(got, key=key) == sorted(_plain_contamination(texts, [(r.item_id, r.text) for r in items.collect()]), key=key)


def test_many_terms_take_several_passes(spark, docs, monkeypatch):
    from archtrail.llm import decontaminate as d

    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(rows_of(d.contamination(docs, items).drop("spans", "items")), key=key)
    monkeypatch.setattr(d, "TERMS_A_PASS", 300)
    monkeypatch.setattr(d, "BROADCAST_BYTES", 0)
    assert sorted(rows_of(d.contamination(docs, items).drop("spans", "items")), key=key) == whole


def test_proximity_matches(spark):
    from archtrail.llm import decontaminate as d

    docs = spark.createDataFrame([(1, "red green blue"), (2, "red big green blue"), (3, "red and one two green blue")], "doc long, text string").select("doc", F.xxhash64("text").alias("text_key"), d.words_of(F.col("text")).alias("words"))
    windows = d.windows_of(spark.createDataFrame([(1, "red green")], "item_id long, text string"), "item_id", "text", 13)
    counts = d.frequencies(docs, [["red", "green"]])
    index = d.postings(docs, [["red", "green"]])
    found = lambda slop: {r.doc for r in d.phrase_starts(index, d.starting_points(windows, counts), slop).collect()}
    assert (found(0), found(1), found(3)) == ({1}, {1, 2}, {1, 2, 3})


def test_contamination_of_empty_tables(spark, docs, none):
    from archtrail.llm.decontaminate import contamination

    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert contamination(none, items).count() == 0
    assert contamination(docs, items.limit(0)).where("n_hit > 0 or contaminated").count() == 0


def test_shards(docs, texts):
    from archtrail.llm.sharding import assign, slots

    held = assign(docs, "doc_id", [1.0] * 16, [1.0] * 17).select("doc_id", "text", "shard", "grown_shard")
    rows = held.collect()
    assert all(r.grown_shard in (r.shard, 16) for r in rows)
    by_key = {}
    for r in rows:
        assert by_key.setdefault(r.doc_id, r.shard) == r.shard
    numbered = slots(held.select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"), "shard"), ["doc_id", "crc"]).collect()
    for shard in range(16):
        own = sorted(r.slot for r in numbered if r.shard == shard)
        assert own == list(range(len(own)))
    assert sorted([(r.doc_id, r.crc) for r in numbered], key=key) == sorted([(d, zlib.crc32((t or "").encode())) for d, t in texts], key=key)


def test_shards_follow_weights(spark):
    from archtrail.llm.sharding import assign

    share = assign(spark.range(20_000), "id", [1.0, 3.0]).groupBy("shard").count().collect()
    assert abs({r.shard: r["count"] for r in share}[1] - 15_000) < 400


def test_shards_of_an_empty_table(none):
    from archtrail.llm.sharding import assign, slots

    assert slots(assign(none, "doc_id", [1.0, 1.0]).select("doc_id", "shard"), ["doc_id"]).count() == 0


def _plain_url(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = []
    for verdict, rule in rules:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail):
            fits.append((len(rule), rule, verdict))
    return host, path, max(fits)[1:] if fits else (None, None)


def test_urls(spark):
    from archtrail.llm.queries import RULES
    from archtrail.llm.url_filter import filter_urls

    urls = [None, "", "no scheme", "http://Example.COM/en/x?a#b", "https://www.example.com/en/", "http://a.net/es/1", "http://a.net/de/1", "x://h?q=://z", "http://example.com", "a://\nb.com/\nc#d", "http://notexample.com/en/", "http://EXAMPLE.com/en"]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([(6, 1), (6, 1), (5, None)], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule) for r in filter_urls(pages, outcomes, RULES).collect()}
    assert got == {k: (*_plain_url(u, RULES)[:2], _plain_url(u, RULES)[2][0]) for k, u in enumerate(urls)}


def test_reputation_shrinks_and_blocks(spark):
    from archtrail.llm.url_filter import domain_of, filter_urls, suffix_of

    rows = [(k, f"http://bad.evil.org/{k}", 1) for k in range(60)] + [(100 + k, f"http://h{k % 20}.good{k % 10}.org/{k}", 0) for k in range(200)]
    rows += [(400, "http://new.evil.org/", None), (401, "http://new.good3.org/", None), (402, "http://one.rare.com/", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, bad int")
    got = {r.page_id: r for r in filter_urls(pages, pages.select("page_id", "bad"), []).collect()}
    assert (got[0].verdict, got[100].verdict, got[401].verdict, got[402].verdict) == ("block", "allow", "allow", "allow")
    assert got[100].share < got[401].share < got[400].share < got[0].share
    names = spark.createDataFrame([("a.b.co.uk",), ("x.de",), ("com",), ("",)], "h string").select(suffix_of(F.col("h")), domain_of(F.col("h")))
    assert rows_of(names) == [("co.uk", "b.co.uk"), ("de", "x.de"), ("com", "com"), ("", "")]
    assert filter_urls(pages.limit(0), pages.select("page_id", "bad"), []).count() == 0


def test_pipeline_equals_the_plain_stages(spark):
    import corpus_pipeline as c

    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = c.quality_rules(spark, docs, SF)
    assert one.columns == names
    rows = sorted((r.doc_id, r.text) for r in one.collect())
    two = c.jaccard_join(spark, one, SF)
    stay = {doc for doc, _, group in _groups(rows, 5, 80) if doc == group}
    assert {r.doc_id for r in two.collect()} == stay
    three = c.suffix_dedup(spark, two, SF)
    assert three.columns == names
    rows = [r for r in rows if r[0] in stay]
    seen, cut = set(), []
    for doc, text in rows:
        body = text.encode()
        gone = {q for p in range(len(body) - 49) if body[p : p + 50] in seen for q in range(p, p + 50)}
        ends = np.cumsum([len(c.encode()) for c in text]).tolist()
        cut.append((doc, "".join(c for c, end in zip(text, ends, strict=True) if not gone & set(range(end - len(c.encode()), end)))))
        seen |= {body[p : p + 50] for p in range(len(body) - 49)}
    cut = [r for r in cut if r[1]]
    assert sorted((r.doc_id, r.text) for r in three.collect()) == cut
    assert all(r.n_chars == len(r.text) for r in three.collect())
    four = c.decontaminate(spark, three, SF)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r[0] for r in _plain_contamination(cut, items) if not r[4]}
    assert {r.doc_id for r in four.collect()} == clean
    assert {r.doc_id for r in c.run(spark, SF).collect()} == clean


def test_pipeline_stages_take_awkward_rows(spark, docs, none):
    import corpus_pipeline as c

    for table in (docs, none):
        rows = table
        for _, stage in c.STAGES[:4]:
            rows = stage(spark, rows, SF)
            assert rows.columns == table.columns
            assert stage(spark, table, SF).count() <= table.count()
        assert c.STAGES[4][1](spark, rows, SF).count() <= table.count()


def test_near_passages(spark):
    from archtrail.llm.decontaminate import near_passages

    item = "red green blue amber violet"
    texts = [(1, f"so {item} end"), (2, "so red green blue pink amber violet"), (3, "red only"), (4, None), (5, "red violet green blue amber"), (6, "red x green x blue x amber x violet")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.doc, r.distance) for r in near_passages(docs, spark.createDataFrame([("i", item)], "item_id string, text string"), slop=4, size=5).collect()}
    counts = {w: sum((t or "").split().count(w) for _, t in texts) for w in item.split()}
    a, b = sorted(range(5), key=lambda k: (counts[item.split()[k]], k))[:2]
    want = set()
    for doc, text in texts:
        w = (text or "").split()
        best = {}
        for i in (k for k, x in enumerate(w) if x == item.split()[a]):
            for j in (k for k, x in enumerate(w) if x == item.split()[b]):
                if abs((j - b) - (i - a)) <= 4:
                    best[i - a] = min(best.get(i - a, 9), abs((j - b) - (i - a)))
        want |= {(doc, d) for d in best.values()}
    assert got == want and (1, 0) in got and any(doc == 6 and d for doc, d in got)


def test_slots_with_names_of_its_own_nulls_and_ties(spark):
    from archtrail.llm.sharding import slots

    rows = [(0, None, "a", "u", 1), (0, None, "a", "u", 1), (0, "k", "b", "v", 2), (1, "k", None, "w", 3), (None, "z", "c", "x", 4)]
    frame = spark.createDataFrame(rows, "shard int, key string, slot_group string, copies string, before int").withColumn("Start", F.lit("s")).withColumn("of_shard", F.lit(7))
    got = slots(frame, ["key"])
    assert got.columns == [*frame.columns, "slot"]
    found = rows_of(got)
    assert sorted((r[:5] for r in found), key=key) == sorted(rows, key=key)
    by_shard = {}
    for r in found:
        by_shard.setdefault(r[0], []).append(r[-1])
    assert {k: sorted(v) for k, v in by_shard.items()} == {0: [0, 1, 2], 1: [0], None: [0]}
