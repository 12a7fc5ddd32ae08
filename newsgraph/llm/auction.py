"""Cheapest repairs of a conversation by the auction algorithm for shortest paths.

A node of the lattice is a row and a state of the grammar ``(s?(ua)+)?``; arcs
keep, rerole or delete the row, or insert a turn before it, at integer costs. An
auction grows one path from an origin: where the last node's price is under that
of its best arc, the price rises and the path contracts by that node, else the
path extends along the arc, until it meets a node whose price is settled. Prices
p then fulfil ``p(i) <= cost(i, j) + p(j)``, with equality, a tight arc, all
along every cheapest path; the cheapest edits are traced along tight arcs,
always the least letter that leads to the end.

The lattice is cut into blocks of ``BLOCK`` rows, settled from the last one to
the first with an auction from each entry, so the work is linear in the rows,
and blocks that look alike are solved once per worker.
"""

from __future__ import annotations

from newsgraph.llm.words import worker_cache

BLOCK = 4
REMEMBERED = 200_000
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
# States: nothing yet, after a system turn, after a user turn, after an assistant turn.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
AFTER = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
# What a conversation may end with.
FINAL = (EMPTY, ASSISTANT)
ROLES = "suax"
OK, BLANK, DUPLICATE, CUT = range(4)


def symbol(role: str, fault: int) -> str:
    """One character for a row: the initial of its role (x: any other) and its first fault."""
    return chr(ord("A") + 4 * fault + ROLES.index(role if role in "sua" else "x"))


def role_of(sign: str) -> str:
    return ROLES[(ord(sign) - ord("A")) % 4]


def fault_of(sign: str) -> int:
    return (ord(sign) - ord("A")) // 4


def _inserts(state: int) -> list[tuple[str, int]]:
    return [(role, AFTER[state, role]) for role in "ua" if (state, role) in AFTER]


def arcs(rows: str, node: tuple[int, int]) -> list[tuple[str, str, int, tuple[int, int]]]:
    """``(letter, role, cost, next node)`` of the edits possible at a node, least letters first."""
    row, state = node
    inserts = [("I", role, INSERT, (row, after)) for role, after in _inserts(state)]
    if row == len(rows):
        return inserts
    role, fault = role_of(rows[row]), fault_of(rows[row])
    made = [("D", "", DELETE, (row + 1, state)), *inserts]
    if fault in (BLANK, DUPLICATE):
        return made
    extra = TRUNCATED if fault == CUT else 0
    if (state, role) in AFTER:
        made.append(("K", "", KEEP + extra, (row + 1, AFTER[state, role])))
    made += [("R", r, REROLE + extra, (row + 1, after)) for r, after in _inserts(state)]
    return made


def settle(rows: str, exits: tuple[int, ...], last: bool) -> dict[tuple[int, int], int]:
    """Prices of a block's nodes, exact at its entries.

    ``exits`` are the exact prices behind the block's rows; the ``last`` block has
    no rows, and its final states lead to the end at no cost.
    """
    if last:
        end = (1, EMPTY)
        ways = {(0, s): arcs("", (0, s)) + ([("", "", 0, end)] if s in FINAL else []) for s in STATES}
        price, settled, start = {end: 0}, {end}, 0
    else:
        ways = {(r, s): arcs(rows, (r, s)) for r in range(len(rows)) for s in STATES}
        price = {(len(rows), s): exits[s] for s in STATES}
        settled, start = set(price), min(exits)
    price |= dict.fromkeys(ways, start)
    for state in STATES:
        path = [(0, state)]
        while path[-1] not in settled:
            node = path[-1]
            level, after = min((cost + price[to], to) for _, _, cost, to in ways[node])
            if price[node] < level:
                price[node] = level
                if len(path) > 1:
                    path.pop()
            else:
                path.append(after)
        # Every node of the path has its exact price now: later paths may end there.
        settled.update(path)
    return price


def _trace(rows: str, price: dict, state: int) -> tuple[tuple[tuple[str, str], ...], int]:
    """The least letters along tight arcs from an entry to an exit, with roles, and the exit's state."""
    dead: set[tuple[int, int]] = set()
    path, taken = [(0, state)], []
    while path[-1][0] < max(len(rows), 1):
        node = path[-1]
        ways = arcs(rows, node)
        if not rows and node[1] in FINAL:
            ways = [*ways, ("", "", 0, (1, EMPTY))]
        tight = [w for w in ways if price[node] == w[2] + price[w[3]] and w[3] not in dead]
        if tight:
            letter, role, _, after = min(tight, key=lambda w: w[0])
            path.append(after)
            taken.append((letter, role))
        else:
            dead.add(path.pop())
            taken.pop()
    return tuple(taken), path[-1][1]


def _block(rows: str, exits: tuple[int, ...], last: bool) -> tuple:
    """Entry prices and, per entry, the edits to an exit and its state. Remembered by look."""
    cache = worker_cache().setdefault("auction_blocks", {})
    base = min(exits)
    key = rows, tuple(e - base for e in exits), last
    if key not in cache:
        if len(cache) >= REMEMBERED:
            cache.clear()
        price = settle(rows, key[1], last)
        cache[key] = tuple(price[0, s] for s in STATES), tuple(_trace(rows, price, s) for s in STATES)
    entries, traces = cache[key]
    return tuple(e + base for e in entries), traces


def cheapest_edits(rows: str) -> tuple[int, list[tuple[str, str]]]:
    """The least cost of repairing ``rows`` (one symbol each) and the edits, as letters with a new role or ''.

    Of the cheapest ways it is the one whose letters are least. Linear in the rows.
    """
    exits, traces = _block("", (0, 0, 0, 0), True)
    solved = [traces]
    for stop in range(len(rows), 0, -BLOCK):
        exits, traces = _block(rows[max(stop - BLOCK, 0) : stop], exits, False)
        solved.append(traces)
    state, edits = EMPTY, []
    for traces in reversed(solved):
        taken, state = traces[state]
        edits += [e for e in taken if e[0]]
    return exits[EMPTY], edits
