"""Near duplicates of the pipeline: fingerprints and tables of distances stand before every exact comparison; what a stage shuffles."""

import numpy as np

from quillstream.llm import similar

SETS = "id long, hashes binary, print binary"
KEYED = "id long, b int, key long"


def top(root, x):
    while root[x] != x:
        x = root[x]
    return x


def groups(edges, n):
    root = {k: k for k in range(n)}
    for a, b in edges:
        root[top(root, a)] = top(root, b)
    of = {}
    for k in range(n):
        of.setdefault(top(root, k), set()).add(k)
    return sorted(map(sorted, of.values()))


def test_no_pair_of_a_run_passes_by_the_fingerprints(spark):
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**63, 80).astype(np.uint64))
    sets = [base, base[1:], base[2:], base[3:]]
    prints = [similar.wide_fingerprint(x) for x in sets]
    keyed = spark.createDataFrame([(k, 0, 5) for k in range(4)], KEYED)

    def linked(prints):
        rows = [(k, bytearray(x.tobytes()), bytearray(p.tobytes())) for k, (x, p) in enumerate(zip(sets, prints))]
        return groups([tuple(r) for r in similar.links(spark.createDataFrame(rows, SETS), keyed).collect()], 4)

    assert linked(prints) == [[0, 1, 2, 3]]
    # Sets alike whose fingerprints are far apart: the table of distances discards them before they are compared.
    rng = np.random.default_rng(4)
    assert linked([rng.integers(0, 2**64, 8, dtype=np.uint64) for _ in prints]) == [[0], [1], [2], [3]]


def test_links_of_runs_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    sets = []
    for _ in range(9):
        base = rng.integers(0, 2**63, 50).astype(np.uint64)
        sets += [np.unique(np.concatenate([base[rng.permutation(50)[: rng.integers(42, 50)]], rng.integers(0, 2**63, rng.integers(0, 4)).astype(np.uint64)])) for _ in range(5)]
    rows = [(k, bytearray(x.tobytes()), bytearray(similar.wide_fingerprint(x).tobytes())) for k, x in enumerate(sets)]
    n = len(sets)
    # One run of all rows, its repetition, runs of two to four rows.
    runs = [list(range(n)), list(range(n)), *([int(x) for x in rng.permutation(n)[: rng.integers(2, 5)]] for _ in range(20))]
    keyed = spark.createDataFrame([(x, k % 3, k) for k, run in enumerate(runs) for x in run], KEYED)
    found = [tuple(r) for r in similar.links(spark.createDataFrame(rows, SETS), keyed).collect()]
    pairs = [(i, j) for i in range(n) for j in range(i) if similar.similarity(sets[i], sets[j]) >= 0.8]
    assert groups(found, n) == groups(pairs, n)


def test_shared_keys_take_one_shuffle_and_no_row_is_lost_between_batches(spark):
    rng = np.random.default_rng(5)
    rows = [(k, int(rng.integers(0, 2)), int(x)) for k, x in enumerate(rng.integers(-40, 40, 150))] + [(1000 + k, 0, 99) for k in range(25)] + [(2000, 1, 99)]
    keyed = spark.createDataFrame(rows, KEYED)
    count = {}
    for _, b, key in rows:
        count[b, key] = count.get((b, key), 0) + 1
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "3", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            found = similar.in_runs(keyed)
            assert sorted(map(tuple, found.select("id", "b", "key").collect())) == sorted(r for r in rows if count[r[1:]] > 1)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
