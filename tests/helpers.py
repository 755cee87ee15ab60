"""Small DataFrame builders for hand-made fixtures."""

from sosrank.schemas import COMPETITORS, CONTESTS, MATCHUPS

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


def competitor(name, grp, strength=100, grp2=None, id_=None, stats=(10, 20, 30, 40, 50, 60), image=None):
    return (id_ if id_ is not None else abs(hash(name)) % 10**9, name, grp, grp2, *stats, strength, image)


def make_competitors(spark, rows):
    return spark.createDataFrame(rows, COMPETITORS)


def make_matchups(spark, cells):
    from sosrank.functions.labels import MATCHUP_LABELS
    labels = dict(MATCHUP_LABELS)
    return spark.createDataFrame([(a, d, float(m), labels.get(float(m), "other")) for a, d, m in cells], MATCHUPS)


def make_contests(spark, rows):
    """rows: (attacker, defender, attacker_won[, date]) -> contests with generated ids."""
    import datetime as dt
    out = []
    for i, r in enumerate(rows):
        a, d, won = r[:3]
        day = r[3] if len(r) > 3 else dt.date(2024, 1, 1) + dt.timedelta(days=i)
        out.append((f"c{i:05d}", a, d, a if won else d, None, None, None, None, None, day))
    return spark.createDataFrame(out, CONTESTS)


def ancestors(plan: str, marker: str) -> list[str]:
    """The operators of a printed plan above the first line that holds ``marker``, the nearest first."""
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if marker in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    above, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            above.append(line)
            level = depth(line)
    return above
