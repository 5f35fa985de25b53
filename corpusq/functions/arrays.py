"""Small array helpers for work that stays inside one row."""

from pyspark.sql import Column, functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    Binding through a one-element array keeps the optimizer from copying a
    costly expression into a lambda that runs once per element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def ints(*values) -> Column:
    return F.array(*values).cast("array<int>")


def at(array: Column, index: Column) -> Column:
    """Zero-based element, NULL when out of range."""
    return F.get(array, index)


def indexes(array: Column) -> Column:
    """0 .. size-1, empty for an empty array."""
    return F.transform(array, lambda _, i: i)


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0), lambda a, x: a + x.cast("int"))


#: Elements that ``fold`` takes at once, at least.
FOLD_BLOCK = 32


def fold(items: Column, zero: Column, names: list[str], out: Column, step, finish=lambda acc: acc, block: int = FOLD_BLOCK) -> Column:
    """``F.aggregate`` with a list that only grows, in time close to linear in the items.

    The accumulator is a struct of ``names`` and of "out", which ``step`` may
    append to but not read; ``zero`` has the names, ``out`` is the empty list.
    Spark copies the whole accumulator at every element.  Here an inner fold
    over a block of elements starts with an empty list, and an outer one appends
    the lists of the blocks, so a long list is copied once per block.  A block has
    ``block`` elements or the square root of all, so neither list grows long.
    """
    def with_out(acc, grown):
        return F.struct(*[acc[n].alias(n) for n in names], grown.alias("out"))

    def over(bound):
        def in_blocks(n):
            def one_block(acc, b):
                inner = F.aggregate(F.slice(bound, b * n + 1, n), with_out(acc, out), step)
                return let(inner, lambda made: with_out(made, F.concat(acc["out"], made["out"])))
            last = F.greatest(F.ceil(F.size(bound) / n).cast("int") - 1, F.lit(0))
            return F.aggregate(F.sequence(F.lit(0), last), let(zero, lambda z: with_out(z, out)), one_block, finish)
        return let(F.greatest(F.lit(block), F.ceil(F.sqrt(F.size(bound))).cast("int")), in_blocks)
    return let(items, over)
