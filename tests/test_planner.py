import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidelog.functions import names
from tidelog.operators.writers import chunks
from tidelog.plans import planner, policy
from tidelog.plans.shuffle import exact_order


@st.composite
def cases(draw):
    n_old, n_new = draw(st.integers(1, 6)), draw(st.integers(1, 6))
    w = math.lcm(n_old, n_new) * draw(st.integers(1, 4))
    return n_old, n_new, w, draw(st.integers(0, w // n_old)), draw(st.integers(0, 5))


@given(cases())
@settings(max_examples=300, suppress_health_check=[HealthCheck.too_slow])
def test_resume_rounds_down_and_covers_the_rest(case):
    n_old, n_new, w, cursor, seq = case
    done = cursor * n_old
    s, step = planner.resume_start(seq, cursor, n_old, n_new, w)
    assert (s, step) == (seq + 1, 0) if done == w else (s == seq and step * n_new <= done < (step + 1) * n_new)
    first = s * w + step * n_new
    assert 0 <= seq * w + done - first < n_new and planner.replayed_positions(cursor, n_old, n_new) == (done % n_new)
    dealt = sorted(p * n_new + r for r in range(n_new) for p in range(planner.steps_per_segment(w, n_new)))
    assert dealt == list(range(w))


def test_worked_examples():
    assert [planner.resume_start(2, 2, 3, n, 12) for n in (3, 2, 4)] == [(2, 2), (2, 3), (2, 1)]
    assert planner.replayed_positions(2, 3, 4) == 2 and planner.resume_start(2, 4, 3, 2, 12) == (3, 0)
    with pytest.raises(ValueError):
        planner.resume_start(0, 5, 3, 2, 12)
    with pytest.raises(ValueError):
        planner.steps_per_segment(12, 5)
    assert planner.permitted(12, 1, 4) and not planner.permitted(12, 1, 5)


def test_golden_orders():
    assert exact_order(list(range(8)), 7, 0) == [4, 1, 5, 7, 6, 2, 0, 3]
    assert exact_order(list(range(8)), 7, 1) == [7, 6, 4, 0, 5, 1, 3, 2]


def test_tails():
    assert list(chunks(list(range(10)), 4, "wrap")) == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 0, 1]]
    assert list(chunks(list(range(10)), 4, "drop")) == [[0, 1, 2, 3], [4, 5, 6, 7]]
    assert list(chunks([0, 1, 2], 8, "wrap")) == [[0, 1, 2, 0, 1, 2, 0, 1]]
    with pytest.raises(ValueError):
        list(chunks(list(range(10)), 4, "error"))
    with pytest.raises(ValueError):
        chunks([1], 1, "other")


def test_lanes_of_a_plan(spark):
    plan = spark.createDataFrame([(2, p, 24 + p, f"b{p}") for p in range(12)], "seq long, pos long, position long, block_id string")
    assert [r.position for r in planner.lane(plan, 0, 3).orderBy("step").collect()] == [24, 27, 30, 33]
    assert [r.position for r in planner.lane(plan, 2, 3, 2).orderBy("step").collect()] == [32, 35]
    assert planner.lane(plan, 0, 3, 4).count() == 0
    with pytest.raises(ValueError):
        planner.lane(plan, 3, 3)


def test_wrap_and_error_in_frames(spark):
    blocks = spark.createDataFrame([(f"b{i}",) for i in range(3)], "block_id string")
    order = planner.pass_order(blocks, 7)
    got = planner.cut_segments(order, 8, "wrap").orderBy("slot").collect()
    assert [r.slot for r in got] == list(range(8)) and [r.block_id for r in got[:3]] * 3 == [r.block_id for r in got] + [got[2].block_id]
    with pytest.raises(Exception, match="multiple"):
        planner.cut_segments(order, 2, "error").collect()


def test_expected_counts():
    assert [policy.expected_checkpoints(*x) for x in ((4, 12, 2, 2), (4, 12, 2, None), (1, 12, 3, 5))] == [12, 4, 1]
    assert policy.expected_reports(2, 12, 2, "every_k", 4) == 3 and policy.expected_reports(2, 12, 2, "any", 4) == 4
    assert policy.expected_reports(2, 12, 2, "any", 4, True) == 12


def test_policies():
    s = lambda i, e=0.0, p=False: policy.Step(i, 4, p, e)
    assert list(policy.fold(policy.EveryKSteps(3), map(s, range(1, 5)))) == [False, False, True, False]
    budget = policy.TimeBudget(5, 2)
    assert list(policy.fold(budget, [s(i, 2.0 * i) for i in range(1, 9)])) == [False, False, False, True, False, False, False, True]
    both = policy.AnyOf([policy.SegmentEnd(), policy.TimeBudget(5)])
    # steps 2 3 4 1 2 3 at 3 6 9 12 15 18 s: 6 s since the start, then the segment's end at 9, then 6 s after it
    assert list(policy.fold(both, [s(i % 4 + 1, 3.0 * i) for i in range(1, 7)])) == [False, True, True, False, True, False]
    assert both.column() is None and policy.Never().decide(s(1)) is False
    # steps of 0.6 s, asked on every second one of the run, which goes on whoever fires: k fires on 3 6 9 12, the budget on 2 4 8 10
    timed = policy.build_policy("any", 3, 1.0, 2)
    timed.tests = timed.tests[:1]
    assert [i for i, fires in enumerate(policy.fold(timed, [s(i, 0.6 * i) for i in range(1, 13)]), 1) if fires] == [2, 3, 6, 8, 9, 12]
    timed = policy.TimeBudget(5)
    timed.checkpointed(s(1, 20.0))
    assert not timed.decide(s(2, 24.0)) and timed.decide(s(3, 25.0))
    for kind in ("every_k", "time"):
        with pytest.raises(ValueError):
            policy.build_policy(kind)
    with pytest.raises(ValueError):
        policy.build_policy("sometimes")
    with pytest.raises(ValueError):
        policy.EveryKSteps(0)


def test_names():
    assert names.checkpoint_name(0, 2, 2) == "checkpoint_g000000_p000004_n02_a00" and names.segment_file(2) == "00000002.json"
    for bad in ("", ".x", "a/b"):
        with pytest.raises(ValueError):
            names.check_block_id(bad)
    for bad in ("", "/x", "a/../b", "a//b"):
        with pytest.raises(ValueError):
            names.check_locator(bad)
