"""The program graph: construction by calls, rate checks, DOT export.

``Program`` is the kernel/stream/call interface; calls only build a plan, and
``wait`` runs it.  Hierarchical kernels are functions that make further calls.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from ..stream import Stream


def _walk(node: tuple, ids: dict[int, int], out: list[tuple[int, str, dict, list[int]]]) -> int:
    if id(node) in ids:
        return ids[id(node)]
    op, rates, parents = node
    above = [_walk(p, ids, out) for p in parents if p]
    ids[id(node)] = len(out)
    out.append((len(out), op, dict(rates), above))
    return ids[id(node)]


def nodes(s: Stream) -> list[tuple[int, str, dict, list[int]]]:
    """(id, operator, rates, inputs) in topological order."""
    out: list = []
    if s.trace:
        _walk(s.trace, {}, out)
    return out


def to_dot(s: Stream) -> str:
    """The graph in DOT, before anything runs."""
    lines = ["digraph stream {"]
    for i, op, rates, above in nodes(s):
        label = op + "".join(f"\\n{k}={v}" for k, v in rates.items())
        lines.append(f'  n{i} [label="{label}"];')
        lines += [f"  n{a} -> n{i};" for a in above]
    return "\n".join([*lines, "}"])


def check_rates(s: Stream, declared: dict[str, dict[str, int]]) -> list[str]:
    """Declared rates that differ from an operator's real ones."""
    wrong = []
    for _, op, rates, _ in nodes(s):
        for k, v in declared.get(op, {}).items():
            if k in rates and rates[k] != v:
                wrong.append(f"{op}: {k} is {rates[k]}, declared {v}")
    return wrong


class Program:
    """Build a graph by kernel, stream and call, then wait for a kernel.

    A kernel is called once.  ``uncall`` detaches its output; ``become`` is the
    operator of that name.  A call with several outputs takes a kernel that
    returns a list of streams.
    """

    def __init__(self) -> None:
        self._made: dict[str, Stream | None] = {}
        self._called: dict[Callable, list[str]] = {}

    def stream(self, name: str) -> str:
        self._made.setdefault(name, None)
        return name

    def call(self, kernel: Callable, ins: Sequence[str] = (), outs: Sequence[str] = ()) -> None:
        if kernel in self._called:
            raise ValueError("a kernel instance is called once")
        given = []
        for name in ins:
            if self._made.get(name) is None:
                raise ValueError(f"nothing writes the stream {name} yet")
            given.append(self._made[name])
        result = kernel(*given)
        many = [] if result is None else result if isinstance(result, list) else [result]
        if len(many) != len(outs):
            raise ValueError("the kernel's outputs and the streams differ in number")
        self._made.update(zip(outs, many, strict=True))
        self._called[kernel] = list(outs)

    def uncall(self, kernel: Callable) -> None:
        for name in self._called.pop(kernel):
            self._made[name] = None

    def output(self, name: str) -> Stream:
        made = self._made.get(name)
        if made is None:
            raise ValueError(f"nothing writes the stream {name}")
        return made

    def wait(self, name: str) -> DataFrame:
        """The rows of a stream in order; running it is up to the caller's action."""
        return self.output(name).ordered()
