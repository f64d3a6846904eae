import random
from difflib import SequenceMatcher

from cartulary.operators import duplicates, similar_names as S


def test_bounds_lose_no_pair():
    """Long names, names of one letter, and names with a letter more often than it has bits; of names with the same letters few are left to match."""
    rng = random.Random(8)
    found = {"a" * k for k in range(1, 30)} | {"".join(rng.choices("abcd", k=rng.randint(55, 75))) for _ in range(60)} | {"".join(rng.choices("ab1", k=rng.randint(1, 9))) for _ in range(80)}
    for x in sorted(found):
        k = rng.randrange(len(x))
        found |= {x[:k] + x[k + 1 :], x[:k] + "z" + x[k:]}
    found = sorted(found - {""})
    block = S._Block(found)
    left = {(int(a), int(b)) for p, q in S._hopeful(block, block, 0.82) for a, b in zip(p, q, strict=True)}
    want = {(i, j) for j, y in enumerate(found) for i, x in enumerate(found[:j]) if SequenceMatcher(None, x, y).ratio() >= 0.82}
    assert left >= want and len(want) > 300
    same = S._Block(["".join(rng.sample("abcdefghijklmnopqrst", 20)) for _ in range(300)])
    assert sum(len(p) for p, _ in S._hopeful(same, same, 0.82)) < 50


def test_short_names_are_matched_in_arrays(spark, monkeypatch):
    """Ratios are difflib's to the last bit, with the name that is first in order as its first, without difflib for names of a word or less; so for blocks of few names
    and for names of more than a word, which difflib matches."""
    rng = random.Random(13)
    found = {"".join(rng.choices(letters, k=rng.randint(1, 64))) for letters in ("ab", "abc", "on", "etaoinshrdlu0123456789") for _ in range(12)}
    for x in sorted(found):
        k = rng.randrange(len(x))
        found |= {x[:k] + x[k + 1 :], x[k:] + x[:k], x[:k] + "q" + x[k + 1 :], x[:k][::-1] + x[k:]}
    short = sorted(found - {""})
    calls = []

    class Counting(SequenceMatcher):
        def __init__(self, junk, a, b):
            calls.append(len(a) + len(b))
            super().__init__(junk, a, b)

    monkeypatch.setattr(S, "SequenceMatcher", Counting)
    monkeypatch.setattr(S, "COLUMNS", 64)
    for names in (short, [x for x in short if len(x) > 30][:80] + [x + "y" * 10 for x in short if 60 < len(x) < 64][:40]):
        half = len(names) // 3
        one, two = S._Block(names[:half]), S._Block(names[half:])
        for a, b, order in ((one, two, 0), (two, one, 1), (two, two, 2)):
            got = {}
            for x, y in S._hopeful(a, b, 0.82):
                ratio, turned = S._ratios(a, x, b, y)
                for i, j, r, t in zip(x.tolist(), y.tolist(), ratio.tolist(), turned.tolist(), strict=True):
                    assert t == (a.names[i] > b.names[j]) and (i, j) not in got
                    got[i, j] = r
            want = {}
            for i, p in enumerate(a.names):
                for j, q in enumerate(b.names):
                    if order < 2 or i < j:
                        r = SequenceMatcher(None, *sorted((p, q))).ratio()
                        if r >= 0.82:
                            want[i, j] = r
            assert {k: r for k, r in got.items() if r >= 0.82} == want and len(want) > 5
    assert all(n > 65 for n in calls) and calls


def test_few_names_leave_blocks_empty(spark):
    """Fewer names than blocks: most blocks have none; no name and no text at all give no pair."""
    rows = [(i, f"/r/{n}.txt") for i, n in enumerate(["holiday photos", "holiday photo", "x"])]
    files = spark.createDataFrame(rows, "id long, path string").selectExpr("id", "path", "cast(null as string) archive_member")
    assert [(r.a, r.b) for r in S.similar_names(files).collect()] == [("holidayphoto", "holidayphotos")]
    assert S.similar_names(files.where("id < 0")).collect() == []
    none = spark.createDataFrame([], "id long, content string")
    assert duplicates.token_overlap(none).collect() == []
