"""Page-list expressions: arrays of page positions and references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def page_refs(source: Column, n: Column, blank: Column, docsep: Column) -> Column:
    """References to the pages 0..n-1 of a document with their marks."""
    one = lambda i: F.struct(source.alias("source"), i.alias("page"), F.array_contains(blank, i).alias("is_blank"), F.array_contains(docsep, i).alias("is_docsep"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<struct<source:string,page:int,is_blank:boolean,is_docsep:boolean>>"))


def positions(refs: Column, mark: str) -> Column:
    """Positions of the references that carry a mark."""
    at = F.transform(refs, lambda r, i: F.when(r[mark], i))
    return F.filter(at, lambda i: i.isNotNull())


def taken(items: Column, at: Column) -> Column:
    """The items at the given positions, in the array's order."""
    return F.filter(items, lambda _, i: F.array_contains(at, i))


def without(items: Column, at: Column) -> Column:
    return F.filter(items, lambda _, i: ~F.array_contains(at, i))


def inserted(items: Column, new: Column, at: Column) -> Column:
    """``new`` put before position ``at``, which is kept within the array."""
    place = F.least(F.greatest(at, F.lit(0)), F.size(items))
    return F.concat(F.slice(items, F.lit(1), place), new, F.slice(items, place + 1, F.size(items)))


def moved(items: Column, at: Column, target: Column) -> Column:
    """Move within one array: the positions ``at`` go before what stood at ``target``."""
    before = F.size(F.filter(at, lambda i: i < target))
    return inserted(without(items, at), taken(items, at), target - before)


def reordered(order: Column, dragged: Column, target: Column, after: Column) -> Column:
    """The order after one item is dropped before or after another; out-of-range slots change nothing."""
    n = F.size(order)
    fine = (dragged >= 0) & (dragged < n) & (target >= 0) & (target < n) & (dragged != target)
    rest = F.filter(order, lambda _, i: i != dragged)
    at = F.when(target < dragged, target).otherwise(target - 1) + F.when(after, 1).otherwise(0)
    return F.when(fine, inserted(rest, F.array(F.get(order, dragged)), at)).otherwise(order)


def remapped(marks: Column, order: Column) -> Column:
    """Marked pages under their new positions; pages that left are dropped."""
    new = F.transform(marks, lambda m: F.array_position(order, m) - 1)
    return F.sort_array(F.filter(new, lambda i: i >= 0))


def marked_blank(blank: Column, docsep: Column, page: Column) -> Column:
    return F.struct(F.sort_array(F.array_union(blank, F.array(page))).alias("blank"), F.array_except(docsep, F.array(page)).alias("docsep"))


def display_to_page(w: Column, h: Column, rotation: Column, shown_w: Column, shown_h: Column, left: Column, top: Column, right: Column, bottom: Column, least: float = 2.0) -> Column:
    """A selection on the displayed page as a rectangle of the unrotated page; null if too small."""
    share = lambda x, size: F.least(F.greatest(x, F.lit(0.0)), size) / size
    u, v = (share(left, shown_w), share(right, shown_w)), (share(top, shown_h), share(bottom, shown_h))
    u0, u1, v0, v1 = F.least(*u), F.greatest(*u), F.least(*v), F.greatest(*v)
    turn = lambda a, b, c, d: F.when(rotation == 90, b).when(rotation == 180, c).when(rotation == 270, d).otherwise(a)
    x0, x1 = w * turn(u0, v0, 1 - u1, 1 - v1), w * turn(u1, v1, 1 - u0, 1 - v0)
    y0, y1 = h * turn(v0, 1 - u1, 1 - v1, u0), h * turn(v1, 1 - u0, 1 - v0, u1)
    return F.when((x1 - x0 >= least) & (y1 - y0 >= least), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))
