"""Filling fixed-capacity containers by bin completion: branch and bound over undominated fillings."""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sangam.session import materialise

BLOCK_ITEMS = 4096
STEPS = 400  # steps of the enumeration around one largest item
NODES = 20_000  # containers closed or reopened in the search over one block


def lower_bound(items: list[int], capacity: int) -> int:
    """Containers needed at the least: items over half never share, whatever small ones fill up beside them."""
    sizes = sorted(items)
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    best = -(-sums[-1] // capacity)
    half = bisect.bisect_right(sizes, capacity // 2)
    for k in {0, *(s for s in sizes[:half])}:
        lo, full = bisect.bisect_left(sizes, k), bisect.bisect_right(sizes, capacity - k)
        full = max(full, half)
        room = (full - half) * capacity - (sums[full] - sums[half])
        small = max(0, sums[half] - sums[lo] - room)
        best = max(best, len(sizes) - half + -(-small // capacity))
    return best


def _dominated(fill: list[tuple[int, int]], rest: int, count: dict[int, int], avail: int) -> bool:
    """Whether some items of the filling could give way to one larger unused item that still fits."""
    sums = 1
    own = 0
    for s, k in fill:
        if count[s] == k:
            avail &= ~(1 << s)  # none of this size is left over
        own |= 1 << s
        part = 1
        while k > 0:  # multiples of a size by halves
            take = min(part, k)
            sums |= sums << (s * take)
            k -= take
            part *= 2
    if sums & avail & ~own & ~1:
        return True  # several items against one of their total size
    reach, have = sums << 1, 1  # sums plus 1 to rest
    if not rest:
        return False
    while have < rest:
        step = min(have, rest - have)
        reach |= reach << step
        have += step
    return bool(reach & avail)


def fillings(sizes: list[int], count: dict[int, int], room: int, slack: int, steps: int = STEPS) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(room left, [(size, how many)]) of the undominated fillings that leave at most ``slack``.

    Enumerated largest items first; one that leaves nothing is given at once, the others
    in the order of what they leave.  Ends after ``steps`` steps.
    """
    n = len(sizes)
    down = [-s for s in sizes]
    after = [0] * (n + 1)
    avail = 0
    for i in range(n - 1, -1, -1):
        after[i] = after[i + 1] + sizes[i] * count[sizes[i]]
        avail |= 1 << sizes[i]
    later: list[tuple[int, list[tuple[int, int]]]] = []
    frames = [[0, -1, room]]  # where in sizes, how many of that size (-1: not begun), room before them
    while frames and steps > 0:
        steps -= 1
        f = frames[-1]
        if f[1] < 0:
            i = bisect.bisect_left(down, -f[2], f[0])
            if f[2] - after[i] > slack:
                frames.pop()
            elif i == n or not f[2]:
                fill = [(sizes[g[0]], g[1]) for g in frames[:-1] if g[1]]
                if not _dominated(fill, f[2], count, avail):
                    if f[2]:
                        later.append((f[2], fill))
                    else:
                        yield 0, fill
                frames.pop()
            else:
                f[0], f[1] = i, min(count[sizes[i]], f[2] // sizes[i])
                frames.append([i + 1, -1, f[2] - f[1] * sizes[i]])
        elif f[1] == 0:
            frames.pop()
        else:
            f[1] -= 1
            frames.append([f[0] + 1, -1, f[2] - f[1] * sizes[f[0]]])
    later.sort(key=lambda x: x[0])
    yield from later


def best_fit(items: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the incumbent of the search."""
    rooms: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for s in sorted(items, reverse=True):
        k = bisect.bisect_left(rooms, (s, -1))
        if k == len(rooms):
            bins.append([s])
            bisect.insort(rooms, (capacity - s, len(bins) - 1))
        else:
            room, j = rooms.pop(k)
            bins[j].append(s)
            bisect.insort(rooms, (room - s, j))
    return bins


def complete_bins(items: list[int], capacity: int, steps: int = STEPS, nodes: int = NODES) -> list[list[int]]:
    """Containers of ``items`` (each of 1 to ``capacity``), by bin completion.

    Each level takes the largest item left and branches over its undominated fillings, least
    waste first, going back to other fillings of earlier containers while what is wasted
    in all allows fewer containers than the incumbent has.  The incumbent is best-fit decreasing until a
    better packing is found; one that meets the lower bound ends the search.  The packing is optimal unless ``steps``
    or ``nodes`` ran out; then it is the incumbent.
    """
    best = best_fit(items, capacity)
    if not items:
        return best
    total, bound = sum(items), lower_bound(items, capacity)
    count = Counter(items)
    order = sorted(count, reverse=True)
    levels: list[list] = []  # largest item, its fillings to come, the filling in use, waste before it
    waste, left = 0, nodes
    while len(best) > bound:
        slack = (len(best) - 1) * capacity - total - waste  # waste that may still come
        order_now = [s for s in order if count[s]]
        if not order_now and slack >= 0:
            best = [[big, *(s for s, k in fill for _ in range(k))] for big, _, fill, _ in levels]
            continue
        if order_now:
            big = order_now[0]
            count[big] -= 1
            if not count[big]:
                order_now.pop(0)
            levels.append([big, fillings(order_now, count.copy(), capacity - big, max(slack, -1), steps), None, waste])
        while levels:
            level = levels[-1]
            big, more, fill, waste = level
            for s, k in fill or ():
                count[s] += k
            left -= 1
            rest, fill = next(more, (None, None)) if left > 0 else (None, None)
            if fill is not None and waste + rest <= (len(best) - 1) * capacity - total:
                for s, k in fill:
                    count[s] -= k
                level[2] = fill
                waste += rest
                break
            count[big] += 1
            levels.pop()
        if not levels:
            break
    return best


def _solve(round_no: int, steps: int, nodes: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        spec, block = key
        cap = int(pdf["cap"].iloc[0])
        pdf = pdf.sort_values(["n", "id"], kind="stable")
        by_size = {n: g.tolist() for n, g in pdf.groupby("n").indices.items()}
        where = [0] * len(pdf)
        fill = [0] * len(pdf)
        for k, items in enumerate(complete_bins(pdf["n"].tolist(), cap, steps, nodes)):
            total = sum(items)
            for s in items:
                at = by_size[s].pop()
                where[at], fill[at] = k, total
        return pdf.assign(container=[f"{spec}-{round_no}-{block}-{k}" for k in where], fill=fill)[["spec_id", "cap", "id", "piece", "start", "n", "container", "fill"]]

    return run


def pack(sizes: DataFrame, specs: DataFrame, steps: int = STEPS, nodes: int = NODES, block_items: int = BLOCK_ITEMS, rounds: int = 3, tight: float = 0.99) -> DataFrame:
    """(spec_id, container, doc_id, piece, start_token, n_tokens): every token placed once.

    ``sizes``: (id, n); ``specs``: (spec_id, capacity_tokens).  A text longer than a
    container fills whole containers of its own and its rest is an item; no other text is
    divided.  Texts without tokens need no room and are left out, as are specs of no
    capacity.  Items are solved in blocks of about ``block_items`` by a hash of the id, so
    no task grows with the data; what lies in containers filled below ``tight`` is
    gathered from all blocks and solved again, so that a block's last container does not
    stay half empty.  Equal sizes are taken in id order.
    """
    s = F.broadcast(specs.select("spec_id", F.col("capacity_tokens").cast("long").alias("cap")).where("cap > 0"))  # a handful of capacities
    base = sizes.select("id", F.col("n").cast("long").alias("n")).where("n > 0").crossJoin(s)
    whole = F.expr("IF(n > cap, n div cap, 0L)")
    long = base.where(F.col("n") > F.col("cap")).withColumn("piece", F.explode(F.sequence(F.lit(0), whole - 1)))
    full = long.select("spec_id", F.concat_ws("-", "spec_id", F.lit("x"), "id", "piece").alias("container"), F.col("id").alias("doc_id"), "piece", (F.col("piece") * F.col("cap")).alias("start_token"), F.col("cap").alias("n_tokens"))
    rest = F.col("n") - whole * F.col("cap")
    items = base.select("spec_id", "cap", "id", whole.cast("long").alias("piece"), (whole * F.col("cap")).alias("start"), rest.alias("n")).where("n > 0")
    out = full
    for r in range(rounds):
        many = items.count() if r == 0 else left
        blocks = max(1, -(-many // block_items))
        keyed = items.withColumn("block", F.pmod(F.xxhash64("id", F.lit(100 + r)), F.lit(blocks)))
        cols = "spec_id int, cap long, id long, piece long, start long, n long, container string, fill long"
        solved = materialise(keyed.groupBy("spec_id", "block").applyInPandas(_solve(r, steps, nodes), cols), "packed")
        last = r == rounds - 1
        done = solved if last else solved.where(F.col("fill") >= F.col("cap") * F.lit(tight))
        out = out.unionByName(done.select("spec_id", "container", F.col("id").alias("doc_id"), "piece", F.col("start").alias("start_token"), F.col("n").alias("n_tokens")))
        if last:
            break
        items = solved.where(F.col("fill") < F.col("cap") * F.lit(tight)).select("spec_id", "cap", "id", "piece", "start", "n")
        left = items.count()
        if not left:
            break
    return out
