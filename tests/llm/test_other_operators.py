"""URL rules, mixing, language, Merkle fingerprints, toxicity and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventlens.llm import language, merkle, mixing, toxicity, urls
from eventlens.llm.common import crc_mod
from eventlens.llm.queries import QUERIES, URL_RULES


def test_urls(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    cases = {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme/net/": ("", "", None, "allow"), "http://NET/": ("net", "/", "net/", "block"),
        "http://a.b.net/x?y": ("a.b.net", "/x", "net/", "block"), "http://net": ("net", "", None, "allow"), "http://xnet/": ("xnet", "/", None, "allow"),
        "https://www.Example.net/en/1#t": ("www.example.net", "/en/1", "example.net/en/", "allow"), "https://example.net/EN/": ("example.net", "/EN/", "net/", "block"),
        "x://example.com/de/?q": ("example.com", "/de/", "example.com/de/", "block"), "http://example.com/d": ("example.com", "/d", None, "allow"), "http://o.org/fr/": ("o.org", "/fr/", "org/fr/", "allow"),
        "http://?q": ("", "", None, "allow"), "http://h\u00c9.net/\u00e9": ("h\u00c9.net", "/\u00e9", "net/", "block"), "http://" + "a." * 300 + "net/" + "p/" * 3000: ("a." * 300 + "net", "/" + "p/" * 3000, "net/", "block"),
        "a://b://c.net/": ("b:", "//c.net/", None, "allow"),
    }
    pages = spark.createDataFrame([(k, u, "h", "p", "v") for k, u in enumerate(cases)] + [(3, "http://NET/", "h", "p", "v")], "page_id long, url string, host string, path string, verdict string")
    got = urls.judge(pages, rules).collect()
    assert len(got) == len(cases) + 1
    for r in got:
        assert tuple(r)[1:] == list(cases.values())[r.page_id]
    assert urls.judge(pages.where("false"), rules).count() == 0
    assert {r.verdict for r in urls.judge(pages, rules.where("false")).collect()} == {"allow"}
    with pytest.raises(ValueError, match="two verdicts"):
        urls.judge(pages, rules.union(spark.createDataFrame([("net", "/", "allow")], rules.schema)))


def fill(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = sum(w[s] for s in order if s not in full)
        level = (total - sum(most * sizes[s] for s in full)) / rest if rest else 0
        new = {s for s in order if s not in full and level * w[s] > most * sizes[s]}
        if not new:
            return {s: most * sizes[s] if s in full else level * w[s] for s in order}
        full |= new


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    rng = random.Random(seed)
    docs = [(k, None if rng.random() < 0.05 else "w " * rng.randint(0, 60), rng.choice(["a", "a", "a", "b", "c", "é", "Z", None]) if rng.random() < 0.9 else "tiny", "clash") for k in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, size string").repartition(6)
    got = mixing.mix(df).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for i, t, s, _ in docs:
        sizes[s] += len((t or "").split())
    for r in got:
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
        target[r.source] = r.target
    want = fill(sizes)
    for s, t in want.items():
        assert target[s] == pytest.approx(t) and abs(taken[s] - t) <= max(3, 0.002 * t)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(3)).collect()))


def dense_multiplier(sizes, target, most=3.0):
    """By bisection over all documents of one source."""
    words = lambda x: sum(n * min(most, (1 + n) ** (x / math.log(2))) for n in sizes)
    low, high = -60.0, 60.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if words(mid) < target else (low, mid)
    return low


def test_rates_solve_the_dual(spark):
    """Rates differ within a source, meet its target and are those of a dense solver; where the limit binds they stop at it."""
    rng = random.Random(5)
    docs = [(k, "w " * (rng.randint(1, 20) if k % 3 else rng.randint(100, 400)), rng.choice("aaaabbc")) for k in range(400)]
    got = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    for s in "abc":
        own = [r for r in got if r.source == s]
        assert sum(r.rate * r.size for r in own) == pytest.approx(own[0].target, rel=1e-6)
        if own[0].target < 3 * own[0].source_size * 0.999:
            x = dense_multiplier([r.size for r in own], own[0].target)
            assert all(r.rate == pytest.approx(min(3.0, (1 + r.size) ** (x / math.log(2))), rel=1e-5) for r in own)
            assert len({round(r.rate, 6) for r in own}) > 5
        else:
            assert {r.rate for r in own} == {3.0}


def test_small_sources_are_filled_up(spark):
    docs = [(k, "w " * n, s) for k, (n, s) in enumerate([(40, "a"), (7, "a"), (5, "a"), (3, "a"), (1, "a"), (900, "b"), (60, "b"), (33, "b"), (8, "b"), (2, "b"), (1, "b")])]
    got = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), weights=(1, 5)).collect()
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.01 * own[0].target + 3


def test_mixing_odd(odd, none):
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(none).count() == 0
    assert {r.taken for r in mixing.mix(odd.where("text is null or trim(text) = ''")).collect()} == {0}


def slow_leaves(text):
    parts = [p for p in re.split(r"(?<=\n)|(?<=[.!?] )", text) if p] or [""]
    return [hashlib.md5(p.encode()).hexdigest() for p in parts]


def slow_tree(text):
    """(root, sections) by a plain loop."""
    made, held = [], []
    leaf = slow_leaves(text)
    for k, p in enumerate(leaf):
        held.append(p)
        if p[0] == "0" or k == len(leaf) - 1:
            made.append(hashlib.sha256("".join(held).encode()).hexdigest())
            held = []
    return hashlib.sha256("".join(made).encode()).hexdigest(), made


def slow_dice(a, b):
    a, b = set(slow_leaves(a)), set(slow_leaves(b))
    return 2 * len(a & b) / (len(a) + len(b))


def slow_changes(a, b):
    other = set(slow_tree(b)[1])
    return [k for k, s in enumerate(slow_tree(a)[1]) if s not in other]


def test_merkle(spark, odd, none):
    docs = [(r.doc_id, r.text or "") for r in odd.dropDuplicates(["doc_id"]).collect()]
    df = odd.dropDuplicates(["doc_id"])
    docs.sort()
    got = {r.doc_id: r for r in merkle.fingerprints(df).collect()}
    roots = defaultdict(set)
    for k, (i, t) in enumerate(docs):
        nxt, half = docs[(k + 1) % len(docs)][1], len(t) // 2
        assert got[i].n_chars == len(t) and got[i].edited_text == t[: len(t) - half] + nxt[:half]
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        same = t == got[i].edited_text
        assert (got[i].fingerprint == got[i].edited_fingerprint) == same and (not same or not got[i].changed_sections)
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (slow_tree(t)[0], slow_tree(got[i].edited_text)[0])
        assert got[i].near_edited == pytest.approx(slow_dice(t, got[i].edited_text)) and got[i].near_next == pytest.approx(slow_dice(t, nxt))
        assert got[i].changed_sections == slow_changes(t, got[i].edited_text) and got[i].edited_sections == slow_changes(got[i].edited_text, t)
        roots[t].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in roots.values()) and len({x for v in roots.values() for x in v}) == len(roots)
    assert merkle.fingerprints(odd).count() == odd.count() and merkle.fingerprints(none).count() == 0
    alone = merkle.fingerprints(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert alone.edited_text == "abab" and alone.near_next == 1.0


def test_merkle_likeness_and_sections_follow_edits(spark):
    """One paragraph changed, put in or taken out marks the sections it is in, however many follow."""
    rng = random.Random(1)
    a = [" ".join(str(rng.randint(0, 9999)) for _ in range(8)) + ". " for _ in range(400)]
    rows = {"changed": a[:70] + ["changed here. "] + a[71:], "put in": a[:70] + ["one more here. "] + a[70:], "taken out": a[:70] + a[71:], "same": a}
    df = spark.createDataFrame([(k, "".join(a), "".join(b)) for k, b in rows.items()], "kind string, a string, b string")
    df = df.select("kind", "a", "b", merkle.leaves(F.col("a")).alias("la"), merkle.leaves(F.col("b")).alias("lb"))
    df = df.select("*", merkle.sections(F.col("la")).alias("sa"), merkle.sections(F.col("lb")).alias("sb"))
    out = df.select("kind", "a", "b", "sa", merkle.likeness(F.col("la"), F.col("lb")).alias("near"), merkle.differing_sections(F.col("sa"), F.col("sb")).alias("at"))
    got = {r.kind: r for r in out.collect()}
    for kind, r in got.items():
        assert r.sa == slow_tree(r.a)[1] and len(r.sa) > 10 and r.at == slow_changes(r.a, r.b)
        assert r.near == pytest.approx(slow_dice(r.a, r.b)) and len(r.at) <= (0 if kind == "same" else 2)
    ends = [k + 1 for k, p in enumerate(slow_leaves("".join(a))) if p[0] == "0"]
    assert got["changed"].at[0] == sum(e <= 70 for e in ends)


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    big = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{big}/documents.parquet").collect()}
    got = QUERIES["op7_language"](spark, big).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    books = language.dictionaries(docs, crc_mod(F.col("doc_id"), 4) != 2)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "a"), (5, "the " * 50_000)], "doc_id long, text string")
    out = {r.doc_id: r for r in language.predict(odd, books).collect()}
    assert [out[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and out[5].lang_pred == "en" and out[4].lang_pred in books
    assert {r.lang_pred for r in language.predict(odd, {}).collect()} == {"und"}
    assert language.predict(odd.where("false"), books).count() == 0 and language.dictionaries(docs.where("false"), F.lit(True)) == {}


def test_language_against_plain_compression(spark, sf):
    """Predictions are those of a fresh compressor a block with the same dictionaries; repeated rows and other columns don't matter."""
    import zstandard

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    books = language.dictionaries(docs, crc_mod(F.col("doc_id"), 4) != 2)
    more = docs.unionByName(docs.limit(5)).withColumns({"lang_pred": F.lit("clash"), "score": F.lit(7), "h": F.lit(1), "at": F.lit(1), "piece": F.lit("x")})
    assert language.dictionaries(more, crc_mod(F.col("doc_id"), 4) != 2) == language.dictionaries(docs.unionByName(docs.limit(5)), crc_mod(F.col("doc_id"), 4) != 2)
    got = language.predict(more, books).collect()
    assert len(got) == docs.count() + 5
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got[::7]:
        plain, size = language.plain(texts[r.doc_id]), {}
        for lang in sorted(books):
            book = zstandard.ZstdCompressionDict(books[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            press = lambda b: zstandard.ZstdCompressor(dict_data=book, level=language.LEVEL, write_content_size=False, write_dict_id=False).compress(b)  # noqa: E731, B023
            size[lang] = sum(len(press(plain[k : k + language.BLOCK])) for k in range(0, len(plain), language.BLOCK))
        assert r.lang_pred == min(size, key=lambda x: (size[x], x))


def slow_nearest(index, v, k):
    scores = []
    for d in range(index.n):
        s = 0.0
        for t, w in v.items():
            at = list(index.docs[index.term[t]])
            if d in at:
                s += w * index.weights[index.term[t]][at.index(d)]
        if s > 0:
            scores.append((-s, d))
    return [(-s, d) for s, d in sorted(scores)[:k]]


def test_block_max_is_exact():
    rng = random.Random(1)
    idf = {f"t{k}": 1 + rng.random() for k in range(30)}
    probe = toxicity.Index(idf, [], [], [])
    bags = [{f"t{rng.randrange(30)}": rng.randint(1, 5) for _ in range(rng.randint(1, 8))} for _ in range(400)]
    index = toxicity.Index(idf, [probe.vector(toxicity.Counter(b)) for b in bags], [0] * 400, list(range(400)))
    for _ in range(60):
        v = index.vector(toxicity.Counter({f"t{rng.randrange(30)}": rng.randint(1, 5) for _ in range(rng.randint(1, 6))}))
        got, want = index.nearest(v, 10), slow_nearest(index, v, 10)
        assert [round(s, 9) for s, _ in got] == [round(s, 9) for s, _ in want]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in QUERIES["op10_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in toxic]
    tp = sum(r.predicted and toxic[r.doc_id] for r in got)
    assert tp / sum(toxic[r.doc_id] for r in got) > 0.85 and tp / sum(r.predicted for r in got) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_toxicity_odd(spark, odd, none):
    labels = odd.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")).union(spark.createDataFrame([(None, 1), (4, None)], "doc_id long, toxic int"))
    for lab in (labels, labels.where("false")):
        model = toxicity.learn(odd, lab, F.lit(True))
        out = toxicity.score(odd, model).collect()
        assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
        assert toxicity.score(none, model).count() == 0


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at, rows = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, sf).cache()
        rows[name] = at.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert at.columns == docs.columns
    assert list(rows) == ["quality rules", "simhash near-dedup", "secret scans", "mixing sources", "bpe encoding"]
    assert docs.count() > rows["quality rules"] > rows["simhash near-dedup"] == rows["secret scans"] and rows["mixing sources"] == rows["bpe encoding"]
    assert corpus_pipeline.run(spark, sf).count() == rows["bpe encoding"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    clean = corpus_pipeline.quality_rules(spark, docs, sf)
    kept = {r.doc_id for r in clean.collect()}
    assert all(len(texts[i].split()) >= 50 for i in kept)
    mail = spark.createDataFrame([(1, "é password=hunter22 end", "en", "s", 23), (2, "clean", "en", "s", 5), (3, None, "en", "s", None)], docs.schema)
    scanned = corpus_pipeline.secret_scan(spark, mail, sf)
    assert sorted((r.doc_id, r.text, r.n_chars) for r in scanned.collect()) == [(1, "é [secret] end", 14), (2, "clean", 5), (3, None, None)]


def test_pipeline_odd(spark, odd, none):
    for docs in (odd, none):
        at = docs.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, "")
            at.count()


def test_registered_mixing_and_fingerprints(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    for r in QUERIES["op8_fingerprints"](spark, sf).collect():
        k = next(k for k, (i, _) in enumerate(docs) if i == r.doc_id)
        t, nxt = docs[k][1], docs[(k + 1) % len(docs)][1]
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
    assert QUERIES["op6_mixing"](spark, sf).columns == ["doc_id", "size", "source_size", "target", "taken"]
