import random

from millrace.operators import rings


def plain(ways):
    """Rings and chains of one owner's ways {way: points} by walking from end to end; ends pair in order of the ways."""
    ends = {}
    for w in sorted(ways):
        p = ways[w]
        if p[0] != p[-1]:
            ends.setdefault(p[0], []).append((w, 0))
            ends.setdefault(p[-1], []).append((w, 1))
    mate = {}
    for met in ends.values():
        for a, b in zip(met[::2], met[1::2]):
            mate[a], mate[b] = b, a
    for w, p in ways.items():
        if p[0] == p[-1]:
            mate[w, 0], mate[w, 1] = (w, 1), (w, 0)
    todo, out = set(ways), []

    def walk(w, back):
        path = []
        while True:
            path.append((w, back))
            tip = mate.get((w, 0 if back else 1))
            if tip is None:
                return path, False
            if tip[0] == path[0][0]:
                return path, True
            w, back = tip[0], tip[1] == 1

    while todo:
        w = min(todo)
        path, closed = walk(w, False)
        if not closed:  # start from the end that is the lesser way
            tail = path[-1]
            path, _ = walk(tail[0], not tail[1])
            if path[0][0] > path[-1][0]:
                path, _ = walk(path[-1][0], not path[-1][1])
            elif len(path) == 1:
                path = [(w, False)]
        line = []
        for k, (v, back) in enumerate(path):
            p = ways[v][::-1] if back else ways[v]
            line += p if k == 0 else p[1:]
        out.append((path[0][0], closed, line))
        todo -= {v for v, _ in path}
    return sorted(out)


def check(spark, data):
    """data: {owner: {way: points}}."""
    df = spark.createDataFrame([(o, w, p) for o, ways in data.items() for w, p in ways.items()], "relation string, id long, line array<string>")
    got = {}
    for r in rings.assembled(df, "relation", "id", "line").collect():
        got.setdefault(r.relation, {}).setdefault((r.ring, r.closed), []).append((r.position, r.point))
    for o, ways in data.items():
        ours = sorted((ring, closed, [p for _, p in sorted(at)]) for (ring, closed), at in got.get(o, {}).items())
        assert all(sorted(i for i, _ in at) == list(range(len(at))) for at in got.get(o, {}).values())
        assert ours == plain({w: p for w, p in ways.items() if len(p) > 1})


def test_rings_chains_and_single_ways(spark):
    square = {5: list("ab"), 2: list("cb"), 9: list("cxd"), 4: list("ad")}
    two = {1: list("abc"), 2: list("cba"), 3: list("de"), 4: list("fe"), 5: list("fd")}
    gap = {7: list("cd"), 3: list("ab"), 8: list("bc"), 1: list("ef")}
    closed = {2: list("abca"), 1: list("az"), 3: list("zy")}
    check(spark, {"square": square, "two": two, "gap": gap, "closed": closed, "one": {1: list("ab")}, "short": {1: ["a"], 2: list("bc")}, "back": {2: list("ab"), 1: list("cb")}})


def test_long_and_random_ways(spark):
    rng = random.Random(4)
    names = [f"p{i}" for i in range(150)]
    long = {}
    for i, w in enumerate(rng.sample(range(1000), 150)):
        line = [names[i], f"m{i}", names[(i + 1) % 150]]
        long[w] = line[::-1] if rng.random() < 0.5 else line
    tangle = {w: [str(rng.randrange(9)), f"m{w}", str(rng.randrange(9))] for w in range(60)}
    check(spark, {"long": long, "open": dict(list(long.items())[:-1]), "tangle": tangle})


def test_no_ways(spark):
    df = spark.createDataFrame([], "relation string, id long, line array<string>")
    assert rings.assembled(df, "relation", "id", "line").collect() == []
