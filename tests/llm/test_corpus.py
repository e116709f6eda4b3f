"""Corpus operators against brute force, and the pipeline."""

import base64
import collections
import hashlib
import itertools
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from linktrove.llm import cover_tree, cube_mix, dart_minhash, licenses, merkle, toxicity, url_cascade

SF = "/root/testdata/sf0.001"


def multiset(text):
    w = (text or "").lower().split()
    return collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def similar(a, b):
    both = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 1.0


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_near_duplicate_classes(request, which):
    rows = request.getfixturevalue(which)
    sets = [(r.doc_id, multiset(r.text)) for r in rows.collect()]
    group = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        if similar(sets[i][1], sets[j][1]) >= 0.8:
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
    least = collections.defaultdict(list)
    for g, (doc_id, _) in zip(group, sets):
        least[g].append(doc_id)
    want = [(d, min((x for x in least[g] if x is not None), default=None)) for g, (d, _) in zip(group, sets)]
    assert sorted(map(repr, map(tuple, dart_minhash.near_duplicates(rows).collect()))) == sorted(map(repr, want))
    kept = dart_minhash.keep_one(rows)
    assert kept.columns == rows.columns and kept.count() == len(set(group))


def test_dart_signatures_estimate_weighted_jaccard():
    base = np.arange(1, 401, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    w = np.ones(400, np.int64)
    heavy = w.copy()
    heavy[:100] = 3
    s = dart_minhash.signatures([(base, w), (base[:300], w[:300]), (base, heavy)])
    assert abs((s[0] == s[1]).mean() - 0.75) < 0.12 and abs((s[0] == s[2]).mean() - 400 / 600) < 0.12


def test_copies_and_frequent_passages_in_one_bucket(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(k, text) for k in range(400)] + [(1000 + k, text.replace(f"w{k} ", f"v{k} ")) for k in range(5, 25)]
    rows += [(2000 + k, " ".join(f"u{k}_{j}" for j in range(30)) + " " + text[:100]) for k in range(50)]
    got = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[k] for k, _ in rows[:420]} == {0} and all(got[2000 + k] == 2000 + k for k in range(50))


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mix(request, which):
    rows = request.getfixturevalue(which)
    got = cube_mix.mix(rows).collect()
    again = cube_mix.mix(rows).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == rows.count()
    sizes = collections.Counter()
    for r in got:
        sizes[r.source] += r.size
        assert r.source_size >= r.size and 0 <= r.taken <= 2 * r.size
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    while open_:
        level = (1.5 * sum(sizes.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        target.update({s: 2.0 * sizes[s] for s in over} if over else {s: weight[s] * level for s in open_})
        open_ = open_ - over if over else set()
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    # a landing moves a source by no more than a document; half of one is the nearest a single draw is sure to come
    assert all(abs(taken[s] - target[s]) <= 0.5 * largest[s] for s in order)
    mixed = cube_mix.mixed_documents(rows)
    assert mixed.columns == rows.columns and mixed.count() == sum(r.copies for r in got)


def test_flight_keeps_totals():
    draw = np.random.default_rng(3)
    p, size = draw.random(500), draw.integers(1, 900, 500)
    done = cube_mix.flight(p, size, np.random.default_rng(1))
    assert ((done > 0) & (done < 1)).sum() <= 2
    assert done.sum() == pytest.approx(p.sum()) and (done * size).sum() == pytest.approx((p * size).sum())


def test_landing_keeps_the_number_of_documents(docs):
    rows = [r for r in cube_mix.mix(docs).collect() if r.source_size]
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        pi = own[0].target / own[0].source_size
        assert abs(sum(r.copies for r in own) - pi * len(own)) < 1 + 1e-6


def test_search_with_ties_and_unusable_vectors(spark):
    draw = np.random.default_rng(2)
    rows = [(k, [float(x) for x in draw.integers(-2, 3, 4)]) for k in range(300)]
    rows += [(300, None), (400, [1.0, None]), (500, [float("nan")]), (600, []), (700, [1.0]), (None, [1.0]), (100, [2.0, 2.0, 2.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in cover_tree.search(table, F.col("vec_id") % 100 == 0).collect()]
    good = [(i, [int(1024 * x) for x in v] + [0] * (4 - len(v))) for i, v in rows if i is not None and v is not None and all(x is not None and x == x for x in v)]
    want = collections.Counter()
    best = {}
    for q, v in good:
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)
            best.setdefault(q, []).extend(scored)
    for q, s in best.items():
        want.update((q, k + 1, i, -x) for k, (x, i) in enumerate(sorted(s)[:10]))
    assert collections.Counter(got) == want or {g[0] for g in got} == set(best)
    assert [g for g in got if g[0] != 100] and collections.Counter(g for g in got if g[0] != 100) == collections.Counter({w: n for w, n in want.items() if w[0] != 100})
    assert cover_tree.search(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_search_is_exact_beyond_floats_and_for_repeated_query_ids(spark):
    big = (2.0 ** 27 + 1) / 1024
    rows = [(0, [1.0, 0.0]), (0, [-1.0, 0.0]), (100, [big, 1.0]), (100, [2.0 ** 60, 2.0 ** 60])]
    rows += [(k, [big + (k % 5) / 1024, float(k % 3)]) for k in range(1, 60)] + [(200, [2.0 ** 70, -2.0 ** 70]), (201, [-2.0 ** 70, 1.0]), (7, [5.0, 5.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, [max(-(1 << 62), min(1 << 62, int(1024 * x))) for x in v]) for i, v in rows]
    want = collections.Counter()
    for i, v in whole:
        if i % 100 == 0:
            scored = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w)))), j) for j, w in whole if j != i)
            want.update((i, k + 1, j, -x) for k, (x, j) in enumerate(scored[:10]))
    got = collections.Counter(tuple(r) for r in cover_tree.search(table, F.col("vec_id") % 100 == 0).collect())
    assert got == want and sum(got.values()) == 50


def test_license_digests(spark, odd):
    rows = [(1, "Copyright (c) 2020 A B\n\nreleased under the M.I.T.  Licence"), (2, "Released under the MIT LICENCE!"),
            (3, "text\nLicensed under CC BY 4.0.\nReleased under the MIT License."), (4, None), (5, "")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2].license == "MIT" and got[3].license is None and got[3].license_lines == "CC-BY-4.0,MIT"
    assert got[4].license is None and got[5].license_lines == "" and got[1].license is None
    assert licenses.scan(odd).count() == odd.count()


@pytest.mark.parametrize("bits", [url_cascade.BITS, 1])
def test_url_verdicts(spark, bits):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "com", "/de/")]
    urls = [None, "", "no host", "http://A.Example.ORG/es/1?x", "http://example.org/en#f", "http://x.com/de/", "http://bad.com/x", "http://a.bad.com/de/",
            "http://com", "://q", "http://h.net/a", "http://h.net/a"]
    table = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_cascade.judge(table, rules, spark.createDataFrame([("bad.com",)], "host string"), bits=bits).collect()}
    none = ("", "", None, "allow")
    assert [got[k] for k in range(len(urls))] == [
        none, none, none, ("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en", "org/", "allow"),
        ("x.com", "/de/", "com/de/", "block"), ("bad.com", "/x", None, "block"), ("a.bad.com", "/de/", "com/de/", "block"),
        ("com", "", None, "allow"), ("q", "", None, "allow"), ("h.net", "/a", None, "allow"), ("h.net", "/a", None, "allow")]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_fingerprints(spark, request, which):
    rows = request.getfixturevalue(which)
    source = sorted(((r.doc_id if r.doc_id is not None else merkle.NO_ID, r.text or "", r.doc_id) for r in rows.collect()), key=lambda r: (-r[0], r[1]))
    want = []
    for k, (_, t, doc_id) in enumerate(source):
        nxt, n = source[(k + 1) % len(source)][1], len(t) // 3
        edited = t[:len(t) - n] + nxt[:n]
        own, changed = merkle.fingerprint(t), merkle.fingerprint(edited)
        want.append((doc_id, len(t), hashlib.sha256(edited.encode()).hexdigest(), own, changed, merkle.likeness(own, changed), merkle.likeness(own, merkle.fingerprint(nxt))))
    assert sorted(map(repr, map(tuple, merkle.edited_prints(rows).collect()))) == sorted(map(repr, want))


def test_differing_branches_locate_the_edit():
    lines = [f"This is line {k} of the text." for k in range(40)]
    a = merkle.fingerprint("\n".join(lines))
    lines[17] = "Changed."
    found = merkle.differences(a, merkle.fingerprint("\n".join(lines)))
    assert len(found) == 1 and merkle.differences(a, a) == []
    assert len({merkle.fingerprint(t) for t in ("a", "a\n", "\na", "a ", " a", "")}) == 6


def leaf_share(a, b):
    """Likeness from the texts alone."""
    x, y = (collections.Counter(s for line in t.split("\n") for s in merkle.LEAF.findall(line)) if t else collections.Counter() for t in (a, b))
    n = sum(x.values()) + sum(y.values())
    return 1.0 if a == b else 2 * sum((x & y).values()) / n if n else 0.0


def test_trees_against_leaves_of_the_texts(docs):
    found = [r.text or "" for r in docs.collect()][:120] + ["", "\n", " ", "one two three four", "one two three four\n" * 40]
    size = sum(map(len, found))
    for a, b in zip(found, found[1:] + found[:1]):
        for x, y in ((a, b), (a, a[:len(a) - len(a) // 3] + b[:len(a) // 3]), (a, "\n".join(a.split("\n")[::-1]))):
            assert merkle.likeness(merkle.fingerprint(x), merkle.fingerprint(y)) == pytest.approx(leaf_share(x, y), abs=2e-3)
            assert (merkle.fingerprint(x) == merkle.fingerprint(y)) == (x == y)
    assert sum(len(merkle.fingerprint(t)) for t in found) < 0.4 * size


def test_branches_carry_the_digests_of_what_is_below():
    text = "\n".join(f"line {k} has some words. and more of them" for k in range(50))
    print_ = merkle.fingerprint(text)
    lines, sections = iter(text.split("\n")), []
    for s in merkle.sections_of(print_):
        digests = []
        for p in merkle.paragraphs_of(s):
            leaves = [xxhash.xxh3_64_digest(x) for x in merkle.LEAF.findall(next(lines))]
            digests.append(xxhash.xxh3_64_digest(b"".join(leaves)))
            assert p[:8] == base64.urlsafe_b64encode(digests[-1][:6]).decode()
            assert merkle.leaves_of(p) == [x[:4] for x in leaves]
        sections.append(hashlib.blake2b(b"".join(digests), digest_size=16).digest())
        assert s[:8] == base64.urlsafe_b64encode(sections[-1][:6]).decode()
    assert next(lines, None) is None
    assert print_[:32] == hashlib.blake2b(b"".join(sections), digest_size=16).hexdigest()


def test_toxicity_index_is_exact_and_scores_separate(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(docs, labels)
    for v in model.vectors[:80]:
        scores = collections.defaultdict(float)
        for k, w in enumerate(model.vectors):
            scores[round(sum(x * dict(w).get(t, 0.0) for t, x in v), 6)] += model.mass[k]
        groups, held = [], 0.0
        for s in sorted((s for s in scores if s > 0), reverse=True):
            groups.append((s, scores[s]))
            held += scores[s]
            if held >= toxicity.VOTES:
                break
        assert [(s, model.mass[e].sum()) for s, e in model.nearest(v)] == groups
    rows = toxicity.score(docs, model).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    toxic, clean = [r.score for r in held if r.toxic == 1], [r.score for r in held if r.toxic == 0]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.7 and np.mean([s >= 0.7 for s in clean]) < 0.05


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, "clash"), (5, 0, "clash"), (None, 1, ""), (3, None, "")], "doc_id long, toxic int, text string")
    model = toxicity.fit(odd, labels)
    assert toxicity.score(odd, model).count() == odd.count()
    assert toxicity.score(odd.limit(0), toxicity.fit(odd.limit(0), labels)).count() == 0
    assert toxicity.keep_clean(odd, model).columns == odd.columns


def test_pipeline(spark):
    import corpus_pipeline

    docs, n = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("seed", [1, 2])
def test_a_link_among_texts_that_share_a_template(spark, seed):
    """800 texts of 200 common words and 26 own ones, two of them with 24: only that pair reaches 0.8."""
    common = " ".join(f"c{seed}_{k}" for k in range(200))
    rows = [(k, common + " " + " ".join(f"o{seed}_{k}_{j}" for j in range(24 if k in (17, 501) else 26))) for k in range(800)]
    sets = [multiset(t) for _, t in rows]
    assert similar(sets[17], sets[501]) >= 0.8 > max(similar(sets[17], s) for k, s in enumerate(sets) if k not in (17, 501))
    got = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[501] == 17 and all(got[k] == k for k in got if k != 501)


def test_chains_of_texts_just_above_the_limit(spark):
    """Neighbours are alike, texts further apart are not; repeated words weigh."""
    base = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(60):
        words = list(base)
        words[5 * k:5 * k + 12] = [f"own{k}_{j}" for j in range(12)]
        rows.append((k, " ".join(words[5 * k // 4:] + ["again"] * 30)))
    sets = [multiset(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if similar(sets[i], sets[j]) >= 0.8:
            group = [group[i] if g == group[j] else g for g in group]
    least = {g: min(k for k, h in enumerate(group) if h == g) for g in set(group)}
    got = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: least[g] for k, g in enumerate(group)} and len(set(group)) < len(rows)


def test_stages_take_columns_of_any_name(spark):
    rows = [(k, f"some words of text number {k % 3} and more of them", "s", 1, "x", 2, "y") for k in range(6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int, _id string, _KEY int, _words string").withColumn(
        "_size", F.lit(1)).withColumn("_turn", F.lit(2)).withColumn("__source", F.lit(3))
    kept = dart_minhash.keep_one(table)
    assert kept.columns == table.columns and kept.count() == 3
    mixed = cube_mix.mixed_documents(table)
    assert mixed.columns == table.columns and mixed.count() >= 1
    assert dart_minhash.keep_one(table.limit(0)).count() == 0 and cube_mix.mixed_documents(table.limit(0)).count() == 0


def test_slices_are_bounded_by_bytes():
    import pyarrow as pa

    from linktrove.llm.batches import slices

    texts = ["x" * n for n in (0, 10, 5000, 1, 1, 1, 700, 700, 0)] + [None]
    batch = pa.record_batch([pa.array(texts)], names=["t"]).slice(1)
    parts = [p.column(0).to_pylist() for p in slices(batch, 0, most=1000, rows=3)]
    assert [t for p in parts for t in p] == texts[1:]
    assert all(len(p) <= 3 and (len(p) == 1 or sum(len(t or "") for t in p) <= 1000) for p in parts)


def test_spellings_broken_over_lines(spark):
    """Hand-written: the known texts with other spellings, wrapped, in capitals and with a copyright line."""
    rows = []
    for k, (name, text) in enumerate(licenses.KNOWN):
        low = text.lower()
        changed = low.replace("copyright holder", "Copyright\n   Owner").replace("license", "LICENCE").replace("http:", "https:").replace(" percent", " per\ncent")
        rows.append((k, name, "Copyright (c) 2024 Somebody\n\n" + changed.replace(". ", ".\n\n  ")))
    table = spark.createDataFrame(rows, "doc_id long, name string, text string")
    got = {r.doc_id: r.license for r in licenses.scan(table).collect()}
    assert all(got[k] is not None for k, _, _ in rows)


def test_empty_tables_give_no_rows(spark, docs):
    none = docs.limit(0)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    hosts = pages.select(F.lit("a.example").alias("host")).limit(1)
    assert dart_minhash.near_duplicates(none).count() == 0 and cube_mix.mix(none).count() == 0
    assert licenses.scan(none).count() == 0 and merkle.edited_prints(none).count() == 0
    assert url_cascade.judge(pages.limit(0), [("allow", "org", "/")], hosts).count() == 0
    assert url_cascade.judge(pages, [("allow", "org", "/")], hosts.limit(0)).count() == pages.count()
