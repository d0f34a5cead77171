"""Programs as text: goldens, lowering by rates, serial fallbacks, errors."""

import pytest
import simulator as sim
from test_laws import make, values

from runnel.plans.text import load
from runnel.sources import counter

ADD = "int->int filter Add(int k) { work pop 1 push 1 { push(pop() + k); } }\n"
SOURCE = "void->int filter Count { int x; init { x = 0; } work push 1 { push(x++); } }\n"
SINK = "int->void filter Show { work pop 1 { println(pop()); } }\n"


def printed(spark, text, limit):
    return [int(r.v) for r in load(spark, text, limit=limit)(None).ordered().collect()]


def test_sources_and_sinks(spark):
    """Whole programs, against plain loops."""
    stages = "void->void pipeline P { add Count; for (int k = 3; k > 0; k--) add Add(k * k); add Show; }"
    assert printed(spark, ADD + SOURCE + SINK + stages, 12) == [i + 14 for i in range(12)]
    inner = "int->int splitjoin S(int n) { split roundrobin(n); for (int i = 0; i < n; i++) add int->int filter { work { push(pop() * n - i); } }; join roundrobin(n); }"
    parts = sim.split(list(range(18)), [3, 3, 3])
    want = sim.join([[x * 3 - i for x in part] for i, part in enumerate(parts)], [3, 3, 3])
    assert printed(spark, ADD + SOURCE + SINK + inner + "void->void pipeline P { add Count; add S(3); add Show; }", 18) == want
    table = """static { int[2][3] T; init { for (int i = 0; i < 2; i++) T[i][2] = 7 - i; } }
    void->int filter Rows { int[2][3] own = {{4, 5, 6}, {1, 0, -9}}; work { for (int j = 2; j >= 0; j--) push(own[0][j] * 10 + T[1][j] - own[1][j]); } }
    void->void pipeline P { add Rows; add Show; }"""
    assert printed(spark, SINK + table, 7) == [75, 50, 39, 75, 50, 39, 75]
    with pytest.raises(ValueError, match="limit"):
        load(spark, ADD + SOURCE + SINK + stages)(None)


def test_branches_stay_in_the_jvm(spark):
    data = [(i * 7919) % 1000 - 500 for i in range(47)]
    text = "int sign(int x) { return x < 0 ? -1 : 1; }\nint->int filter F { work { int[2] a; int x = pop(); if (x % 2 == 0) { a[1] = x; push(sign(x)); if (x > 0) push(0); } else a[0] = 5; push(a[0] + a[1]); } }"
    want = []
    for x in data:
        if x % 2 == 0:
            want += [-1 if x < 0 else 1, *([0] if x > 0 else []), x]
        else:
            want.append(5)
    out = load(spark, text, "F")(make(spark, data))
    assert values(out) == want
    plan = out.df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    serial = load(spark, "int->int filter F { work { int x = pop(); if (x > 0) push(pop()); else push(x); } }", "F")
    feed, want = list(data), []
    while feed and not (feed[0] > 0 and len(feed) < 2):
        x = feed.pop(0)
        want.append(feed.pop(0) if x > 0 else x)
    assert values(serial(make(spark, data))) == want


def test_rates(spark):
    data = [(i * 7919) % 1000 - 500 for i in range(47)]
    s = make(spark, data)
    run = lambda body: values(load(spark, "int->int filter F { work { " + body + " } }", "F")(s))
    assert run("int t = 0; for (int i = 0; i < 5; i++) t += peek(i); push(t); pop();") == sim.peek(data, 5, 1, sum)
    assert run("push(peek(0) + peek(2)); pop(); pop();") == sim.peek(data, 3, 2, lambda w: w[0] + w[2])
    assert run("int a = pop(); int b = pop(); push(a - b); push(b);") == [x for i in range(0, 46, 2) for x in (data[i] - data[i + 1], data[i + 1])]
    assert run("int x = pop(); push(x < 0 ? -x : x * 2);") == [-x if x < 0 else x * 2 for x in data]
    assert run("push(pop() / 7 + 1 << 2);") == [int(x / 7) + 4 for x in data]
    assert run("push((int) round(pop() * 0.5));") == [int(abs(x) * 0.5 + 0.5) * (1 if x >= 0 else -1) for x in data]
    # rates that depend on the elements, and state, are folded in order
    assert run("int x = pop(); if (x > 0) push(x);") == [x for x in data if x > 0]
    total = load(spark, "int->int filter F { int t; work { t += pop(); push(t); } }", "F")
    assert values(total(s)) == [sum(data[: i + 1]) for i in range(47)]


def test_plans_stay_in_the_jvm(spark):
    chain = ADD + "int->int pipeline P { for (int i = 0; i < 4; i++) add Add(i); }"
    plan = load(spark, chain, "P")(counter(spark, 100)).df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and plan.count("Project") == 1


def test_weights_and_wrapping(spark):
    text = ADD + "int->int splitjoin S { split roundrobin(3, 1, 2); add Add(0); add Add(1); add Identity<int>; join roundrobin(1, 1, 2); }"
    data = list(range(40))
    parts = sim.split(data, [3, 1, 2])
    assert values(load(spark, text, "S")(make(spark, data))) == sim.join([parts[0], [x + 1 for x in parts[1]], parts[2]], [1, 1, 2])
    assert values(load(spark, ADD, "Add", 1)(make(spark, [2**31 - 1]))) == [-(2**31)]


def fold_of(prework, work, data):
    """A loop: the prework over the first elements, then firings of work; each takes (elements, state), gives (pops, pushes) or None if starved."""
    out, state, fire = [], {}, prework
    while True:
        done = fire(data, state)
        if done is None:
            return out
        data, out, fire = data[done[0] :], out + done[1], work


def test_prework_is_no_state(spark):
    """Fields that only a prework assigns are read by firings in the JVM, with any rates; nothing is folded over all elements."""
    first = "int->int filter F { int t; prework { t = pop(); push(-t); } work { push(pop() - t); } }"
    looks = "int->int filter F { int[2] t; int u; prework { for (int i = 0; i < 40; i++) u = u > peek(i) ? u * 3 : peek(i) + u; t[1] = pop(); pop(); push(u); push(7); } work { push(peek(0) + peek(2) * t[1]); push(u); pop(); } }"
    pairs = "int->int filter F { int t = 9; int u; prework { t = pop() % 7; } work { int a = pop(); int b = pop(); if (a > t) push(a - b); push(b + u); } }"
    maybe = "int->int filter F { int t; prework { t = peek(1); if (t > 0) push(1); push(t); } work { if (pop() > t) push(t); } }"
    skips = "int->int filter F { prework { pop(); pop(); pop(); } work { push(pop()); } }"
    late = "int->int filter F { int n = 3; prework { n = 2; push(0); push(n); } work { int s = 0; for (int i = 0; i < n; i++) s += pop(); push(s); } }"
    sink = "int->void filter F { int t; prework { t = pop(); println(t); } work { println(pop() + t); } }"

    def wide(d, s):
        if len(d) < 40:
            return None
        u = 0
        for x in d[:40]:
            u = (u * 3 if u > x else x + u) % 2**32
            u -= 2**32 if u >= 2**31 else 0
        s["u"], s["t"] = u, d[0]
        return 2, [u, 7]

    def head(n, f):
        return lambda d, s: None if len(d) < n else (s.update(t=f(d)), (n, []))[1]

    wants = {
        first: (lambda d, s: (s.update(t=d[0]), (1, [-d[0]]))[1] if d else None, lambda d, s: (1, [d[0] - s["t"]]) if d else None),
        looks: (wide, lambda d, s: (1, [d[0] + d[2] * s["t"], s["u"]]) if len(d) > 2 else None),
        pairs: (head(1, lambda d: int(d[0] / 7) * -7 + d[0]), lambda d, s: (2, [*([d[0] - d[1]] if d[0] > s["t"] else []), d[1]]) if len(d) > 1 else None),
        maybe: (lambda d, s: (s.update(t=d[1]), (0, [*([1] if d[1] > 0 else []), d[1]]))[1] if len(d) > 1 else None, lambda d, s: (1, [s["t"]] if d[0] > s["t"] else []) if d else None),
        skips: (head(3, lambda d: 0), lambda d, s: (1, d[:1]) if d else None),
        late: (lambda d, s: (0, [0, 2]), lambda d, s: (2, [d[0] + d[1]]) if len(d) > 1 else None),
        sink: (lambda d, s: (s.update(t=d[0]), (1, [str(d[0])]))[1] if d else None, lambda d, s: (1, [str(d[0] + s["t"])]) if d else None),
    }
    data = [(i * 7919) % 1000 - 500 for i in range(47)]
    for text, (prework, work) in wants.items():
        for n in {looks: (47, 39), late: (47, 0)}.get(text, (47, 1)):
            out = load(spark, text, "F")(make(spark, data[:n]))
            assert values(out) == fold_of(prework, work, data[:n]), (text, n)
            assert out.length().first()[0] == len(fold_of(prework, work, data[:n])), (text, n)
    plan = load(spark, first, "F")(make(spark, data)).df._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "BroadcastNestedLoopJoin" in plan
    many = load(spark, first + "int->int filter Add { work { push(pop() + 1); } } int->int pipeline P { add Add; for (int i = 0; i < 6; i++) add F; add Add; }", "P")
    want = [x + 1 for x in data]
    for _ in range(6):
        want = fold_of(*wants[first], want)
    out = many(make(spark, data))
    assert values(out) == [x + 1 for x in want]
    # lazy at first, then a row of its own each: the input isn't read twice as often with each filter
    assert out.df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 16


def test_prework_of_nulls_and_folds(spark):
    """A null first element makes null what depends on it; fields that work assigns are folded as before."""
    from runnel.stream import Stream

    text = "int->int filter F { int t; prework { t = pop(); push(-t); push(5); } work { push(pop() - t); } }"
    rows = Stream(spark.createDataFrame([(0, None), (1, 4)], "seq long, v int"))
    assert values(load(spark, text, "F")(rows)) == [None, 5, None]
    state = "int->int filter F { int t; prework { push(1); push(2); t = 3; } work { push(t); t = pop(); } }"
    assert values(load(spark, state, "F")(make(spark, [7, 8, 9]))) == [1, 2, 3, 7, 8]
    free = "int->int filter F { int t; prework { int n = pop(); for (int i = 0; i < n; i++) t += pop(); } work { push(pop() * t); } }"
    assert values(load(spark, free, "F")(make(spark, [2, 5, 6, 1, 3]))) == [11, 33]
    shared = "static { int g; } int up(int x) { g = x; return x; } int->int filter F { prework { up(pop()); } work { push(pop() + g); } }"
    assert values(load(spark, shared, "F")(make(spark, [2, 5, 6]))) == [7, 8]


def test_errors(spark):
    with pytest.raises(SyntaxError):
        load(spark, "int->int feedbackloop F { }", "F")
    with pytest.raises(NameError):
        load(spark, "void->void pipeline P { add Nothing; }")
    with pytest.raises(ValueError):
        load(spark, "int->int filter F { work { push(1); } }", "F")
