"""An independent, one-element-at-a-time FIFO model of the stream operators."""

from collections import deque


def split(values, weights):
    out, feed = [[] for _ in weights], deque(values)
    while feed:
        for i, w in enumerate(weights):
            for _ in range(w):
                if not feed:
                    return out
                out[i].append(feed.popleft())
    return out


def join(branches, weights, full_rounds=False):
    feeds, out = [deque(b) for b in branches], []
    while True:
        if full_rounds and any(len(f) < w for f, w in zip(feeds, weights, strict=True)):
            return out
        for f, w in zip(feeds, weights, strict=True):
            for _ in range(w):
                if not f:
                    return out
                out.append(f.popleft())


def i32(x):
    return (x + 2**31) % 2**32 - 2**31


def fir(values, taps):
    n, pos = len(taps), 0
    history, out = [0] * n, []
    for v in values:
        history[pos] = v
        total = 0
        for i in range(n):
            total = i32(total + history[(pos + i) % n] * taps[i])
        out.append(total)
        pos = (pos + 1) % n
    return out


def peek(values, k, pop, fn):
    feed, out = deque(values), []
    while len(feed) >= k:
        out.append(fn(list(feed)[:k]))
        for _ in range(min(pop, len(feed))):
            feed.popleft()
    return out
