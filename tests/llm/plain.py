"""Plain versions of the operators on conversations, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

SPACE = " \t\n\x0b\x0c\r"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def key16(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def order_of(turn, role, text):
    return (turn is not None, turn or 0, role, key16(role, text))


def trie(rows: list[tuple]) -> set[tuple]:
    """Nodes of the trie of rebuilt conversations, by walking every prefix of each."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn, role or "", text or ""))
    turns = {c: [x[1:] for x in sorted(r, key=lambda x: order_of(*x))] for c, r in own.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, r in rebuilt.items():
        for d in range(len(r) + 1):
            members[r[:d]].append(c)
    out = set()
    for node, inside in members.items():
        below = [x for x in members if x[: len(node)] == node]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[:-1] == x for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = sorted(c for c in inside if rebuilt[c] == node)
        parent = min(members[node[:-1]]) if node else None
        children = sum(len(x) == len(node) + 1 for x in below)
        out.add((min(inside), len(node), parent, len(inside), children, len(leaves), saved, sha(",".join(map(str, ends)))))
    return out


def damage(rows: list[tuple]) -> dict:
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        fault = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return {c: sorted(r, key=lambda x: order_of(*x)) for c, r in out.items()}


def cheapest(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Least (cost, audit) of (role initial, must go, truncated), over the states of the plain automaton."""
    step = {"u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}, "s": {"": "s"}}

    def inserted(states):
        while True:
            new = dict(states)
            for state, (cost, audit) in states.items():
                for role in "ua":
                    to = step[role].get(state)
                    if to is not None:
                        new[to] = min(new.get(to, (1 << 60, "")), (cost + 2, audit + "I"))
            if new == states:
                return states
            states = new

    states = inserted({"": (0, "")})
    for initial, gone, cut in rows:
        new = {}
        for state, (cost, audit) in states.items():
            options = [(state, 3, "D")]
            for role in "" if gone else "sua":
                to = step[role].get(state)
                if to is not None:
                    options += [(to, cut, "K")] * (role == initial) + [(to, 2 + cut, "R")] * (role != "s")
            for to, more, edit in options:
                new[to] = min(new.get(to, (1 << 60, "")), (cost + more, audit + edit))
        states = inserted(new)
    return min(states[s] for s in ("", "a") if s in states)


def repairs(rows: list[tuple]) -> set[tuple]:
    """Reports of all conversations."""
    after, out = damage(rows), set()
    for conv in {r[0] for r in rows}:
        seen, marks, counts = set(), [], [0, 0, 0]
        for _, role, text in after[conv]:
            visible = text.strip(SPACE)
            blank, duplicate = not visible, (role, text) in seen
            cut = not blank and not duplicate and visible[-1] not in ".!?"
            for i, x in enumerate((blank, duplicate and not blank, cut)):
                counts[i] += x
            seen.add((role, text))
            marks.append((role[:1], blank or duplicate, cut))
        cost, audit = cheapest(marks)
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        turns = [t for t, _, _ in after[conv] if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        kept, left, following = [], iter(after[conv]), "user"
        for edit in audit:
            _, role, text = next(left) if edit != "I" else (None, None, "")
            if edit != "D":
                kept.append((role if edit == "K" else following, text))
                if not (edit == "K" and role[:1] == "s"):
                    following = "assistant" if following == "user" else "user"
        out.add((conv, gaps, *counts, illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in kept))))
    return out
