"""SimHash near-dedup (op 5) against brute force."""

import random
import re

import xxhash

from flowlens.llm import op5_simhash, registry
from flowlens.llm.graph import components
from tests.llm.cases import SF, edge_docs, edge_rows, empty_docs, sf_rows


def fingerprint(text, n=4):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(points, linked):
    """Least member of each point's component; points: (id, value)."""
    parent = list(range(len(points)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if linked(points[i][1], points[j][1]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    out = {}
    for i in range(len(points)):
        out.setdefault(find(i), []).append(points[i][0])
    return sorted((p, min((x for x in m if x is not None), default=None)) for m in out.values() for p in m if p is not None)


def close(a, b):
    return (a ^ b).bit_count() <= 4


def test_table_against_brute_force(spark):
    rows = registry.QUERIES["op5_simhash_near_dedup"](spark, SF).collect()
    docs = sf_rows("documents")
    fp = {d["doc_id"]: fingerprint(d["text"]) for d in docs}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {k: f"{v:016x}" for k, v in fp.items()}
    assert sorted((r["doc_id"], r["component_id"]) for r in rows) == classes(list(fp.items()), close)
    assert len({r["component_id"] for r in rows}) < len(rows)


def test_cases(spark):
    rows = op5_simhash.near_duplicates(edge_docs(spark)).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in rows) == sorted((str(r[0]), f"{fingerprint(r[1]):016x}") for r in edge_rows())
    assert sorted((r["doc_id"], r["component_id"]) for r in rows if r["doc_id"] is not None) == classes(
        [(r[0], fingerprint(r[1])) for r in edge_rows()], close)
    assert op5_simhash.near_duplicates(empty_docs(spark)).count() == 0
    kept = op5_simhash.keep_one(edge_docs(spark))
    assert "piece" in kept.columns and {1, 5, 8, 10} <= {r["doc_id"] for r in kept.collect()}


def test_keep_one_of_each_group_where_ids_repeat(spark):
    rng = random.Random(4)
    a, b, c = (" ".join(str(rng.random()) for _ in range(60)) for _ in range(3))

    def kept(rows):
        return sorted(((r["doc_id"], r["text"]) for r in op5_simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)

    one, two = kept([(1, a), (1, b), (2, b), (3, a)]), [(1, a), (1, b)]
    assert one == sorted(two, key=repr)
    assert kept([(2, a), (2, a), (1, b)]) == sorted([(2, a), (1, b)], key=repr)
    # a missing doc_id comes last, and of rows without one a single one stays
    assert kept([(None, a), (5, a), (None, b), (None, b), (None, c)]) == sorted([(5, a), (None, b), (None, c)], key=repr)
    assert kept([(4, None), (3, ""), (None, "")]) == [(3, "")]


def prints(spark, values):
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, i) for i, v in enumerate(values)], "fp long, least long")
    return df


def test_crowded_keys_lose_no_link(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    values = {base}
    while len(values) < 150:  # a crowd around one value, in steps of up to 4 bits
        v = rng.choice(sorted(values))
        for _ in range(rng.randint(1, 6)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    values = sorted(values | {rng.getrandbits(64) for _ in range(60)})
    want = {}
    for i, root in classes(list(enumerate(values)), close):
        want[i] = root
    for hot in (2_048, 5):
        fps = prints(spark, values)
        found = op5_simhash.key_links(fps, 4, 7, hot)
        links = found.where("b is not null")
        crowded = found.where("b is null").select("a").distinct()
        assert (crowded.count() > 0) == (hot == 5)
        roots = components(links.unionByName(op5_simhash.ball_links(crowded, 4)))
        named = {r["fp"] % (1 << 64): r["root"] for r in fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").collect()}
        groups = {}
        for i, v in enumerate(values):
            groups.setdefault(named[v] if named[v] is not None else ("alone", v), []).append(i)
        assert {i: min(g) for g in groups.values() for i in g} == want


def test_long_chain(spark):
    n = 400
    order = list(range(n))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(5000, 5001), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert len({got[i] for i in range(n)}) == 1 and got[5000] == got[5001] != got[0]
