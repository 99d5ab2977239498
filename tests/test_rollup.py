"""Roll-up of long histories at all levels against one plan at a time, from nothing and after erasures."""

import random

import pytest

from factloom.operators import compaction as c
from factloom.plans.session import stored


def write(df):
    return stored(df, "t")


def next_plan(turns, segments, branch, verbatim, most):
    """The next segment to write, by the rule's words: oldest run first, level by level."""
    old = sorted(turns)[: max(0, len(turns) - verbatim)]
    over = lambda level, at: any(f <= at <= t for lv, f, t, _ in segments if lv == level)
    run = []
    for at in old:
        if over(1, at):
            if len(run) >= 2:
                return 1, run[0], run[-1], len(run)
            run = []
            continue
        run.append(at)
        if len(run) == branch:
            return 1, run[0], run[-1], branch
    for level in range(2, most + 1):
        units = []
        for s in sorted(x for x in segments if x[0] == level - 1):
            if over(level, s[1]):
                if len(units) >= 2:
                    return level, units[0][1], units[-1][2], sum(u[3] for u in units)
                units = []
                continue
            if units and any(units[-1][2] < at < s[1] for at in old):
                units = []
            units.append(s)
            if len(units) == branch:
                return level, units[0][1], units[-1][2], sum(u[3] for u in units)
    return None


def one_at_a_time(turns, segments, branch, verbatim, most):
    held, made = list(segments), []
    while (plan := next_plan(turns, held, branch, verbatim, most)) is not None:
        held.append(plan)
        made.append(plan)
    return sorted(made)


def rolled(spark, histories, segments, branch, verbatim, most):
    turns = spark.createDataFrame([("p", s, at) for s, t in histories.items() for at in t], "scope string, subject string, log_offset long")
    held = spark.createDataFrame([("p", s, *x) for s, xs in segments.items() for x in xs], "scope string, subject string, level int, from_offset long, to_offset long, covered long")
    out = {s: [] for s in histories}
    for r in c.roll_up(turns, held, write, branch, verbatim, most).collect():
        out[r.subject].append((r.level, r.from_offset, r.to_offset, r.covered))
    return {s: sorted(x) for s, x in out.items()}


@pytest.mark.parametrize("branch,verbatim", [(8, 8), (3, 2)])
def test_levels_equal_one_plan_at_a_time(spark, branch, verbatim):
    rng = random.Random(branch)
    histories = {f"u{k}": sorted(rng.sample(range(3000), n)) for k, n in enumerate((620, 300, 73, 17, 9, 8, 1))}
    first = rolled(spark, histories, {s: [] for s in histories}, branch, verbatim, 6)
    assert first == {s: one_at_a_time(t, [], branch, verbatim, 6) for s, t in histories.items()}
    assert {x[0] for x in first["u0"]} >= {1, 2, 3}
    # Erased turns take every segment over them along; then more turns come.
    lost = {s: set(rng.sample(t, len(t) // 25)) for s, t in histories.items()}
    kept = {s: [x for x in first[s] if not any(x[1] <= at <= x[2] for at in lost[s])] for s in histories}
    more = {s: [t for t in ts if t not in lost[s]] + list(range(3000, 3000 + rng.randint(0, 60))) for s, ts in histories.items()}
    again = rolled(spark, more, kept, branch, verbatim, 6)
    assert again == {s: one_at_a_time(more[s], kept[s], branch, verbatim, 6) for s in histories}
    assert any(1 < x[3] < branch for x in again["u0"] if x[0] == 1) and any(x[0] >= 2 for x in again["u0"])


def test_lost_turns_take_their_segments(spark):
    segments = spark.createDataFrame([("p", "u", 1, 0, 7, 8), ("p", "u", 1, 8, 15, 8), ("p", "u", 2, 0, 15, 16), ("p", "v", 1, 0, 7, 8)], "scope string, subject string, level int, from_offset long, to_offset long, covered long")
    lost = spark.createDataFrame([("p", "u", 8), ("p", "u", 99)], "scope string, subject string, log_offset long")
    assert {(r.subject, r.level, r.from_offset) for r in c.after_loss(segments, lost).collect()} == {("u", 1, 0), ("v", 1, 0)}


def test_an_empty_history(spark):
    assert rolled(spark, {}, {}, 8, 8, 6) == {}
