import datetime
import random

from tillroll.operators import analytics
from tillroll.operators.linked import link_groups
from tillroll.session import workspace

FORM = "receipt_id long, user_id string, total_amount decimal(18,2), purchase_date timestamp, store_name string"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def plain_groups(rows, days=1, most=2):
    fine = [r for r in rows if None not in r]
    root = {r[0]: r[0] for r in fine}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = set()
    for p in fine:
        for q in fine:
            if p[0] < q[0] and p[1:3] == q[1:3] and abs((p[3].date() - q[3].date()).days) <= days and edits(p[4].lower(), q[4].lower()) <= most:
                linked |= {p[0], q[0]}
                a, b = sorted((top(p[0]), top(q[0])))
                root[b] = a
    return sorted((x, top(x)) for x in linked)


def frame(spark, rows):
    from decimal import Decimal

    return spark.createDataFrame([(i, u, None if t is None else Decimal(t), d, n) for i, u, t, d, n in rows], FORM)


def test_near_duplicates_against_all_pairs(spark):
    r, names = random.Random(5), ["Tesco", "tescoo", "Tsco", "A", "", "AB", "abc", "Corner Shop", "Corner Shp", "Cornr Shop!", "Elsewhere", None]
    day = datetime.datetime(2024, 1, 1, 9)
    rows = [(i, r.choice(["u", "v", None]), r.choice(["1.00", "2.50", None]), r.choice([None, *(day + datetime.timedelta(days=k, hours=k) for k in range(9))]), r.choice(names)) for i in range(160)]
    got = sorted(map(tuple, analytics.near_duplicate_receipts(frame(spark, rows)).collect()))
    assert got == plain_groups(rows) and len({g for _, g in got}) > 5
    assert analytics.near_duplicate_receipts(frame(spark, rows).limit(0)).count() == 0


def test_what_stands_between_does_not_matter(spark):
    day = datetime.datetime(2024, 1, 1, 9)
    rows = [(1, "u", "5.00", day, "Shop A"), (2, "u", "5.00", day, "Other Place"), (3, "u", "5.00", day + datetime.timedelta(hours=1), "Shop A"), (4, "u", "5.00", day + datetime.timedelta(days=1), "Shop AB"), (5, "u", "5.00", day + datetime.timedelta(days=3), "Shop A")]
    assert sorted(map(tuple, analytics.near_duplicate_receipts(frame(spark, rows)).collect())) == [(1, 1), (3, 1), (4, 1)]


def test_copies_agree_in_each_column(spark):
    day = datetime.datetime(2024, 1, 1)
    rows = [(1, "a", "1.00", day, None), (2, None, "1.00", day, "a"), (3, "a|b", "1.00", day, "c"), (4, "a", "1.00", day, "b|c"), (5, "a", "1.00", day, None), (6, "a", None, None, None), (7, "a", None, None, None)]
    assert sorted(map(tuple, analytics.duplicate_receipts(frame(spark, rows)).collect())) == [(1, 1, 2), (5, 1, 2), (6, 6, 2), (7, 6, 2)]


def test_groups_of_long_ways(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(70, 71), (71, 70), (71, 71), (80, 80)], "a long, b long")
    with workspace(spark, "links") as written:
        got = dict(map(tuple, link_groups(links, written).collect()))
    assert got == {**{i: 0 for i in range(61)}, 70: 70, 71: 70}
