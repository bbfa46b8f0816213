"""Peak concurrency against a plain sweep, and the filter audit against plain Python."""

import itertools
import random
from collections import Counter, defaultdict

from lattica.llm import concurrency, filter_audit
from lattica.llm.queries import op12_concurrency, op13_filter_audit


def brute(rows):
    """(key, from, to, n, w, high, peak) by one sweep for each key."""
    changes = defaultdict(lambda: defaultdict(lambda: [0, 0]))
    for key, start, end, weight in rows:
        if start is None or (end is not None and end <= start):
            continue
        for k in (key, -2):
            for t, sign in ((start, 1), (end, -1)):
                if t is not None:
                    changes[k][t][0] += sign
                    changes[k][t][1] += sign * (weight or 0)
    found = []
    for k, at in changes.items():
        n = w = high = 0
        own = []
        times = sorted(t for t, c in at.items() if any(c))
        for t, after in zip(times, [*times[1:], None], strict=True):
            n, w = n + at[t][0], w + at[t][1]
            high = max(high, n) if own else n
            own.append((k, t, after, n, w, high))
        found += [(*r, r[4] == max(x[4] for x in own)) for r in own]
    return sorted(found, key=str)


def swept(spark, rows, **how):
    df = spark.createDataFrame(rows, "key int, start long, end long, weight long")
    return sorted((tuple(r) for r in concurrency.concurrency(df, **how).select("key", "from_s", "to_s", "n_open", "open_weight", "high_open", "is_peak").collect()), key=str)


def test_sweep_equals_brute_force(spark):
    rng = random.Random(4)
    for width, most in ((10, 4096), (7, 3), (1000, 4096), (1, 4096)):
        rows = []
        for _ in range(150):
            start = rng.choice([None, *range(-30, 90)])
            end = rng.choice([None, (start or 0) + rng.randint(-3, 50)])
            rows.append((rng.randint(0, 2), start, end, rng.choice([None, 0, 5, 7, -3])))
        rows += rows[:20]
        assert swept(spark, rows, width=width, max_buckets=most) == brute(rows)


def test_borders_and_gaps(spark):
    rows = [(1, 0, 10, 5), (1, 10, 20, 5), (1, 20, 20, 9), (1, 5, 40, 1), (2, 10**9, 10**9 + 3, 2), (1, -(10**6), None, 4)]
    assert swept(spark, rows, width=10) == brute(rows)  # 10 changes nothing, 40 is the border of an empty bucket
    assert swept(spark, []) == []


def test_sales(spark):
    sales = spark.createDataFrame(
        [(1, 1, 2.005, "2024-01-01 00:00:00.9", "x"), (2, 2, None, "2024-01-01 00:00:01", "x"), (3, None, float("3"), None, "x"), (None, 9, 1.0, "2024-01-02 00:00:00", "x"), (4, 1, 1.0, "2024-03-01 00:00:00", "x"), (1, 1, 2.0, "2024-01-01 00:00:05", "x")],
        "sale_id long, client_id long, total double, sold_at string, key string",
    ).selectExpr("sale_id", "client_id", "total", "cast(sold_at as timestamp_ntz) sold_at", "key")
    lines = spark.createDataFrame([(1, "2024-01-05 00:00:00.5"), (1, "2024-01-04 00:00:00.5"), (1, None), (2, None), (None, "2024-01-01 00:00:00"), (4, "2024-02-01 00:00:00")], "sale_id long, shipped_at string").selectExpr("sale_id", "cast(shipped_at as timestamp_ntz) shipped_at", "1 as start")
    clients = spark.createDataFrame([(1, 7), (2, None), (None, 3), (1, 8)], "client_id long, nation_id int")
    zone = spark.conf.get("spark.sql.session.timeZone")
    for z in ("UTC", "America/New_York"):  # times without a zone are UTC in any session
        spark.conf.set("spark.sql.session.timeZone", z)
        found = sorted(map(tuple, concurrency.sale_intervals(sales, lines, clients).collect()), key=str)
        assert found == sorted([(7, 1704067200, 1704326400 + 86400, 201), (7, 1704067205, 1704326400 + 86400, 200), (-1, 1704067201, None, 0), (-1, 1704153600, None, 100)], key=str)
    spark.conf.set("spark.sql.session.timeZone", zone)


def test_small_table_has_every_nation(spark):
    found = op12_concurrency(spark, "/root/testdata/sf0.001")
    assert found.where("is_peak").select("nation_id").distinct().count() == found.select("nation_id").distinct().count() > 2
    assert found.where("to_s <= from_s or n_open < 0 or high_open < n_open").count() == 0


def plain_audit(docs, labels):
    good, bad = ({i for i, q, t in labels if i is not None and (q, t)[c] == 1} for c in (0, 1))  # no label without an id
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    masks = []
    for i, text, lang in docs:
        text = text or ""
        words = text.encode().split()
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text), "E": i is not None and least[text] < i}
        masks.append((lang or "", i, fails))
    rows = {}
    for part in {p for p, _, _ in masks}:
        own = [(i, f) for p, i, f in masks if p == part]
        removed_by = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [i for i, f in left if f[letter]]
                left = [(i, f) for i, f in left if not f[letter]]
                failing = sum(f[letter] for _, f in own)
                alone = sum(f[letter] and sum(f.values()) == 1 for _, f in own)
                rows[part, order, step] = [len(left), len(gone), failing - len(gone), alone, sum(i in good for i in gone), sum(i in bad for i in gone)]
                removed_by[letter] += len(gone)
        for (p, order, step), row in rows.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return rows


def audited(spark, docs, labels):
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, lang string, part string")
    found = filter_audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in found.collect()}


def test_audit_equals_plain_python(spark):
    rng = random.Random(8)
    long = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([99, 100, 130]))) for _ in range(6)]
    texts = [*long, long[0] + " #", "A" * 30 + " " + long[1], None, "", "x y\x1cz", "ABC def\x0bG", "one % two", "é" * 20_000 + " " + long[2]]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(150)]
    docs += [(500 + i, long[3], "en") for i in range(120)]  # one text in many partitions
    docs += [(3, docs[3][1], "fr"), (None, "one % two", "en"), (None, "only null", "fr"), (None, long[3], "en"), (10**12, "only null", "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 620, 3)] + [(3, 1, 0), (None, 1, 1)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", 23)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    assert audited(spark, docs, labels) == plain_audit(docs, labels)
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert audited(spark, docs[:40], []) == plain_audit(docs[:40], [])
    assert audited(spark, [], labels) == {}


def test_audit_of_a_table(spark):
    rows = op13_filter_audit(spark, "/root/testdata/sf0.001").collect()
    parts = {r.part for r in rows}
    assert len(rows) == 600 * len(parts)
    for p in parts:  # all orders leave the same documents
        assert len({r.kept for r in rows if r.part == p and r.step == 5}) == 1
