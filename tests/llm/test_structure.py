import hashlib
import itertools
import random
import re
import zlib

from tapelens.llm import structure_repair as repair

FIELDS = "conv_id long, turn long, role string, text string"


def exhaustive(codes):
    """Least (cost, letters) over every choice of edits."""
    options = []
    for role, fault in codes:
        cut = fault == "t"
        stay = [] if fault in "bd" else [("K", cut, role), ("R", 2 + cut, "u"), ("R", 2 + cut, "a")]
        options.append([("D", 3, ""), *stay])
    best = None
    for edits in itertools.product(*options):
        for new in itertools.product(["", "u", "a", "ua", "au"], repeat=len(codes) + 1):
            cost = sum(e[1] for e in edits) + 2 * sum(map(len, new))
            if best and cost > best[0]:
                continue
            if re.fullmatch("(s?(ua)+)?", new[0] + "".join(e[2] + n for e, n in zip(edits, new[1:]))):
                done = "I" * len(new[0]) + "".join(e[0] + "I" * len(n) for e, n in zip(edits, new[1:]))
                best = min(best or (cost, done), (cost, done))
    return best


def stepwise(codes):
    """The same from left to right, for long conversations."""
    places = {0: (0, "")}
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def put(into, place, cost, done):
        into[place] = min(into.get(place, (cost, done)), (cost, done))

    def inserted(now):
        for _ in range(4):
            for (p, role), q in after.items():
                if role != "s" and p in now:
                    put(now, q, now[p][0] + 2, now[p][1] + "I")
        return now

    places = inserted(places)
    for role, fault in codes:
        then, cut = {}, fault == "t"
        for p, (cost, done) in places.items():
            put(then, p, cost + 3, done + "D")
            if fault in "bd":
                continue
            for (q, to), r in after.items():
                if q == p and to == role:
                    put(then, r, cost + cut, done + "K")
                if q == p and to != "s":
                    put(then, r, cost + cut + 2, done + "R")
        places = inserted(then)
    return min(places[p] for p in (0, 3) if p in places)


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)


def brute(rows):
    out, after = {}, list(damaged(rows))
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in after if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, codes = set(), []
        for _, role, text in own:
            bare = text.strip(" \t\n\v\f\r")
            fault = "b" if not bare else "d" if (role, text) in seen else "." if bare[-1] in ".!?" else "t"
            codes.append((role[:1], fault))
            seen.add((role, text))
        cost, done = stepwise(codes)
        out_role, lines, at = "user", [], 0
        for letter in done:
            if letter == "I":
                role, text = out_role, ""
            else:
                _, role, text = own[at]
                at += 1
                if letter == "D":
                    continue
                role = role if letter == "K" else out_role
            lines.append(f"{role}:{text}")
            out_role = "assistant" if role[0] == "u" else "user"
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults = "".join(f for _, f in codes)
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:]))
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, done,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations():
    rng = random.Random(5)
    roles, texts = ["system", "user", "assistant", "tool", "", None], ["Yes.", "No", "Why? ", " \n", "", None, "é!\n"]
    rows = [(c, t, rng.choice(roles[:3] if c % 2 else roles), rng.choice(texts) if rng.random() < .5 else f"t{rng.random()}.")
            for c in range(60) for t in range(rng.randint(1, 9)) if rng.random() < .9]
    rows += [(100, t, "ua"[t % 2] + "x", f"{t % 900}.") for t in range(1500)]  # several blocks
    rows += [(101, t, rng.choice("sua"), f"{rng.random()}") for t in range(300)]
    rows += [(102, None, "user", "a."), (102, None, "user", "a."), (102, 3, "user", "b."), (102, 3, "assistant", "b.")] * 2
    rows += [(None, 0, "user", "lost."), (None, None, "assistant", "x" * 300000), (-7, -2, "system", "only.")]
    return rows


def test_cells_hold_the_least_repair():
    rng = random.Random(1)
    for _ in range(60):
        codes = [rng.choice("suax") + rng.choice("....tbd") for _ in range(rng.randint(1, 4))]
        assert repair.parsed(repair.cell_of("".join(codes))) == exhaustive(codes) == stepwise(codes)


def test_digests_match_brute_force(spark):
    rows = conversations()
    turns = spark.createDataFrame(rows, FIELDS).selectExpr("*", "'clash' as key_", "1 as pos", "2 as cost").repartition(4)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_digests(repair.damaged(turns), turns).collect()}
    assert got == brute(rows)
    assert len(got[100][6]) > 2 * repair.BLOCK


def test_repaired_turns_alternate(spark):
    turns = spark.createDataFrame([(1, 1, "user", "Hi."), (1, 2, "user", "There."), (2, 0, "assistant", "?")], FIELDS)
    got = sorted(tuple(r) for r in repair.repaired_turns(turns).collect())
    assert got == [(1, 0, "user", "Hi."), (1, 1, "assistant", "There."), (2, 0, "user", ""), (2, 1, "assistant", "?")]


def test_empty_table(spark):
    turns = spark.createDataFrame([], FIELDS)
    assert repair.repair_digests(repair.damaged(turns), turns).collect() == []
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    turns = spark.createDataFrame([(dropped, 0, "user", "x.")], FIELDS)
    assert [tuple(r) for r in repair.repair_digests(repair.damaged(turns), turns).collect()] == [
        (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
