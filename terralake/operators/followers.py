"""Counting by distance and time inside one block of space and time, without making the pairs.

A block's points are dealt out to strips and these to tiles of equally many points. The tiles of a strip that lie
wholly within the distance of a centre follow one another, and a run of them is read at once from running counts by
clock hour, whatever the number of its tiles and points; only the tiles that the circle cuts are looked into.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from terralake.functions.scalar import EARTH_RADIUS_KM, chord_km


def follower_counter(km: float, days: int) -> Callable:
    """A function of (centres, points) of one block, for ``cogroup``: per centre and day the smaller points after it and the largest of them.

    Centres have _id, _t, _la, _lo, _s; points the same without an id; both _slot, the block's number in steps of ``days``;
    _t is in microseconds. It refers to nothing outside of itself, so executors need not have this package.
    """
    radius, chord = EARTH_RADIUS_KM, chord_km(km)
    # Steps that stay in a processor's cache.
    pairs_per_step, cells_per_table = 150_000, 4_000_000

    def count(centres, points):
        import numpy as np
        import pandas as pd

        hour, hours = 3_600_000_000, 24 * days

        def sphere(df):
            la, lo = np.radians(df["_la"].to_numpy(float)), np.radians(df["_lo"].to_numpy(float))
            return radius * np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], axis=1)

        def placed(df):
            at = sphere(df)
            good = np.isfinite(at).all(axis=1)
            return df[good], at[good]

        centres, c_at = placed(centres)
        points, p_at = placed(points)
        if not len(centres) or not len(points):
            return pd.DataFrame({"_id": [], "day_after": [], "_n": [], "_s": []}).astype({"_id": object, "day_after": "int64", "_n": "int64", "_s": "float64"})
        begin = int(points["_slot"].iloc[0]) * hours
        order = np.argsort(points["_t"].to_numpy(), kind="stable")
        p_at, p_t = p_at[order], points["_t"].to_numpy()[order]
        p_la, p_lo, p_s = (points[c].to_numpy(float)[order] for c in ("_la", "_lo", "_s"))
        p_h = p_t // hour - begin
        c_t, c_la, c_lo, c_s = centres["_t"].to_numpy(), *(centres[c].to_numpy(float) for c in ("_la", "_lo", "_s"))
        c_s = np.where(np.isnan(c_s), np.inf, c_s)
        c_h = c_t // hour - begin
        c_axes, p_axes = (np.ascontiguousarray(x.T) for x in (c_at, p_at))
        # Squared chords beyond these decide without the great-circle formula.
        sure, never = chord * chord * (1 - 1e-6) - 1e-9, chord * chord * (1 + 1e-6) + 1e-9

        def within(c, p):
            """Whether pairs lie within the distance."""
            gap = 0.0
            for of_c, of_p in zip(c_axes, p_axes):
                step = of_c[c] - of_p[p]
                gap += step * step
            near = gap <= sure
            doubt = np.flatnonzero((gap > sure) & (gap <= never))
            if len(doubt):
                a, b = c[doubt], p[doubt]
                north, east = np.sin(np.radians(p_la[b] - c_la[a]) / 2), np.sin(np.radians(p_lo[b] - c_lo[a]) / 2)
                h = north * north + np.cos(np.radians(c_la[a])) * np.cos(np.radians(p_la[b])) * east * east
                near[doubt] = 2 * radius * np.arcsin(np.minimum(1.0, np.sqrt(h))) <= km
            return near

        columns = days + 1
        number = np.zeros(len(centres) * columns, dtype=np.int64)
        largest = np.full(len(centres) * columns, -np.inf)

        def look(c, rows, start, end, rule=None, smaller=False):
            """Counts those of the points rows[start:end] of each c that are smaller (known if ``smaller``), within the distance and fit the rule."""
            known = np.flatnonzero(end > start)
            c, start, length = c[known], start[known], (end - start)[known]
            total = np.cumsum(length)
            done = 0
            while done < len(c):
                before = total[done - 1] if done else 0
                upto = max(done + 1, int(np.searchsorted(total, before + pairs_per_step, side="right")))
                size = length[done:upto]
                at = np.arange(total[upto - 1] - before) + np.repeat(start[done:upto] - np.cumsum(size) + size, size)
                who, what = np.repeat(c[done:upto], size), rows[at]
                if not smaller:
                    keep = p_s[what] < c_s[who]
                    if rule is not None:
                        keep &= rule(who, what)
                    who, what = who[keep], what[keep]
                keep = within(who, what)
                who, what = who[keep], what[keep]
                if len(who):
                    # Centres come in order, so a step's cells lie close together.
                    cell = who * columns + (p_h[what] - c_h[who]) // 24
                    least = cell.min()
                    found = np.bincount(cell - least)
                    number[least : least + len(found)] += found
                    np.maximum.at(largest, cell, p_s[what])
                done = upto

        # The first and the last clock hour of a window are decided event by event.
        everyone, every = np.arange(len(centres)), np.arange(len(p_t))
        span = days * 24 * hour
        for h, rule in ((c_h, lambda c, p: p_t[p] > c_t[c]), (c_h + hours, lambda c, p: p_t[p] <= c_t[c] + span)):
            look(everyone, every, np.searchsorted(p_h, h), np.searchsorted(p_h, h + 1), rule)
        # So are points that are not smaller than all centres: they are about as rare as centres.
        small = p_s < c_s.min()
        big = np.flatnonzero(~small)
        look(everyone, big, np.searchsorted(p_h[big], c_h + 1), np.searchsorted(p_h[big], c_h + hours))

        rows = np.flatnonzero(small)
        if len(rows):
            # Looking at the tiles and into those that are cut takes least time with about points^(2/3) tiles.
            side = int(max(1, math.sqrt(min((0.75 * len(rows)) ** (2 / 3), cells_per_table / (hours + 48)))))
            tiles = side * side
            # Strips across one direction along the ground, tiles across the other.
            up = p_at[rows].mean(axis=0)
            along = np.cross(up, np.eye(3)[np.argmin(np.abs(up))])
            strip = np.empty(len(rows), dtype=np.int64)
            strip[np.argsort(p_at[rows] @ along, kind="stable")] = np.arange(len(rows)) * side // len(rows)
            order = np.lexsort((p_at[rows] @ np.cross(up, along), strip))
            held = np.bincount(strip, minlength=side)
            place = np.arange(len(rows)) - np.repeat(np.cumsum(held) - held, held)
            tile = np.empty(len(rows), dtype=np.int64)
            tile[order] = np.repeat(np.arange(side), held) * side + place * side // np.repeat(held, held)
            order = np.argsort(tile, kind="stable")  # and by time within a tile
            rows, tile = rows[order], tile[order]
            first = np.searchsorted(tile, np.arange(tiles))
            low, high = np.minimum.reduceat(p_axes[:, rows], first, axis=1), np.maximum.reduceat(p_axes[:, rows], first, axis=1)
            middle, half = (low + high) / 2, (high - low) / 2
            # Points of the tiles and the hours before.
            running = np.zeros((tiles + 1, hours + 1), dtype=np.int64)
            running[1:, 1:] = np.bincount(tile * hours + p_h[rows], minlength=tiles * hours).reshape(tiles, hours)
            np.cumsum(running, axis=1, out=running)
            np.cumsum(running, axis=0, out=running)
            # Largest size of 24 and of 23 hours from each hour on, by doubling; a day without points on both sides. Sizes go by their rank.
            sizes, rank = np.unique(p_s[rows], return_inverse=True)
            width = hours + 48
            eight = np.full((tiles, width + 24), -1, dtype=np.int32)
            np.maximum.at(eight.reshape(-1), tile * (width + 24) + 24 + p_h[rows], rank.astype(np.int32))
            for step in (1, 2, 4):
                eight[:, :-step] = np.maximum(eight[:, :-step], eight[:, step:])
            sixteen = np.maximum(eight[:, :width], eight[:, 8 : width + 8])

            def over_runs(one):
                """Of 1, 2, 4, ... tiles from each tile on."""
                all_of = [one]
                while 2 ** len(all_of) <= side:
                    reach, wider = 2 ** (len(all_of) - 1), all_of[-1].copy()
                    wider[:-reach] = np.maximum(wider[:-reach], wider[reach:])
                    all_of.append(wider)
                return np.stack(all_of)

            day24, day23 = (over_runs(np.maximum(sixteen, eight[:, n : width + n])) for n in (16, 15))
            sizes = np.append(sizes, -np.inf)  # rank -1: no point
            new_strip = np.arange(1, tiles) % side == 0
            per_step, runs_per_step = max(1, pairs_per_step // tiles), max(1, pairs_per_step // (days + 1))
            for some in range(0, len(centres), per_step):
                c = np.arange(some, min(some + per_step, len(centres)))
                near, far = np.zeros((len(c), tiles)), np.zeros((len(c), tiles))
                for axis in range(3):
                    gap = np.abs(c_at[c, axis, None] - middle[axis])
                    far += (gap + half[axis]) ** 2
                    near += np.maximum(gap - half[axis], 0) ** 2
                whole = far <= sure
                # Clock hours at which the days after a centre end, the first without its first hour.
                ends = c_h[c, None] + 24 * np.arange(days + 1)
                ends[:, 0] += 1
                ends = np.clip(ends, 0, hours)
                days_at = np.clip(c_h[c, None] + 24 * np.arange(days), -24, hours) + 24
                first_at = np.clip(c_h[c] + 1, -24, hours) + 24
                # Runs of whole tiles within a strip: the first tile of each and the one after its last.
                joined = whole[:, 1:] & whole[:, :-1] & ~new_strip
                starts, stops = whole.copy(), whole.copy()
                starts[:, 1:] &= ~joined
                stops[:, :-1] &= ~joined
                owner, start = np.nonzero(starts)
                stop = np.nonzero(stops)[1] + 1
                for k in range(0, len(owner), runs_per_step):
                    i, a, b = (x[k : k + runs_per_step] for x in (owner, start, stop))
                    counts = np.diff(running[b[:, None], ends[i]] - running[a[:, None], ends[i]], axis=1)
                    level = np.frexp((b - a).astype(float))[1] - 1
                    a, b = a[:, None], (b - (1 << level))[:, None]
                    best = np.maximum(day24[level[:, None], a, days_at[i]], day24[level[:, None], b, days_at[i]])
                    best[:, 0] = np.maximum(day23[level, a[:, 0], first_at[i]], day23[level, b[:, 0], first_at[i]])
                    own = np.flatnonzero(np.diff(i, prepend=-1))
                    at = c[i[own], None] * columns + np.arange(days)
                    number[at] += np.add.reduceat(counts, own)
                    largest[at] = np.maximum(largest[at], sizes[np.maximum.reduceat(best, own)])
                i, j = np.nonzero(~whole & (near <= never))
                from_, to = (first[j] + running[j + 1, e] - running[j, e] for e in (ends[i, 0], ends[i, -1]))
                look(c[i], rows, from_, to, smaller=True)
        found = np.flatnonzero(number)
        return pd.DataFrame(
            {"_id": centres["_id"].to_numpy()[found // columns], "day_after": found % columns + 1, "_n": number[found], "_s": largest[found]}
        )

    return count
