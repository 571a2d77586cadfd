"""The linear grouping construction in plain Python, as it was measured for the README: right, but too slow a byte for op4."""

import random

import pytest


def _by_first_byte(text: bytes):
    """Places, their inverse, group of each suffix (its first place) and group sizes, by the first byte."""
    order = sorted(range(len(text)), key=text.__getitem__)
    place, group, size = [0] * len(text), [0] * len(text), [0] * (len(text) + 1)
    first = 0
    for at, s in enumerate(order):
        if text[s] != text[order[first]]:
            first = at
        place[s], group[s] = at, first
        size[first] += 1
    return order, place, group, size


def suffix_order(text: bytes) -> list[int]:
    n = len(text)
    order, place, group, size = _by_first_byte(text)
    smaller = [-1] * n  # the last suffix before this one that is in a lower group
    end = n - 1
    while end >= 0:  # groups in descending order
        low = group[order[end]]
        times: dict[int, int] = {}
        for s in sorted(order[low : end + 1]):
            p = s - 1
            while p >= 0 and group[p] >= low:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        for k in sorted(set(times.values()), reverse=True):
            moved: dict[int, list[int]] = {}
            for p in (p for p, t in times.items() if t == k):
                of = group[p]
                size[of] -= 1
                a, z = place[p], of + size[of]
                order[a], order[z] = order[z], p
                place[order[a]], place[p] = a, z
                moved.setdefault(of, []).append(p)
            for of, members in moved.items():
                if size[of] == 0:  # all of it was moved, and stays where it is
                    size[of] = len(members)
                    continue
                size[of + size[of]] = len(members)
                for p in members:
                    group[p] = of + size[of]
        end = low - 1
    out: list[int] = []
    free, ready = list(range(n)), [False] * n
    found = [-1] * n
    for i in range(-1, n):
        p = (n if i < 0 else found[i]) - 1
        while p >= 0 and not ready[p]:
            found[free[group[p]]] = p
            free[group[p]] += 1
            ready[p] = True
            p = smaller[p]
        if i >= 0:
            out.append(found[i])
    return out


@pytest.mark.parametrize("letters", [b"a", b"ab", b"abcd"])
def test_suffix_order_equals_sorted(letters):
    rng = random.Random(7)
    for n in (*range(40), 300):
        text = bytes(rng.choice(letters) for _ in range(n))
        assert suffix_order(text) == sorted(range(n), key=lambda i: text[i:])
