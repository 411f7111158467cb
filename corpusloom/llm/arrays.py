"""Array expressions for long arrays: each takes time in proportion to the array, or to its 1.5th power with
a small factor, without leaving the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a block of a running total; code points of a block of text.
BLOCK, TEXT_BLOCK = 64, 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often, and in whatever lambda, the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def numbers(count: Column, first: int = 1) -> Column:
    """``first`` and the whole numbers after it, ``count`` of them."""
    return F.when(count >= 1, F.sequence(F.lit(first), (count + (first - 1)).cast("int"))).otherwise(F.array().cast("array<int>"))


def running(values: Column, zero: Column, op: Callable[[Column, Column], Column], body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``body`` of a function that gives the total, by ``op``, of the first n values (an array without nulls) for a number n:
    of whole blocks from their running totals, of the rest one by one."""

    def totals(own: Column) -> Column:
        blocks = F.transform(numbers(F.ceil(F.size(own) / BLOCK)), lambda b: F.aggregate(F.slice(own, (b - 1) * BLOCK + 1, BLOCK), zero, op))

        def with_blocks(known: Column) -> Column:
            bases = F.transform(numbers(F.size(known) + 1, 0), lambda b: F.aggregate(F.slice(known, F.lit(1), b), zero, op))

            def with_bases(base: Column) -> Column:
                def first(n: Column) -> Column:
                    block = F.floor(n / BLOCK).cast("int")
                    return F.aggregate(F.slice(own, block * BLOCK + 1, (n - block * BLOCK).cast("int")), F.element_at(base, block + 1), op)

                return body(first)

            return let(bases, with_bases)

        return let(blocks, with_blocks)

    return let(values, totals)


def cutter(text: Column, body: Callable[[Callable[[Column, Column], Column]], Column]) -> Column:
    """``body`` of a function that gives the code points [start, end) of the text without counting from its beginning."""

    def with_blocks(blocks: Column) -> Column:
        def cut(start: Column, end: Column) -> Column:
            block = F.floor(start / TEXT_BLOCK).cast("int")
            there = F.array_join(F.slice(blocks, block + 1, (F.floor(end / TEXT_BLOCK) - block + 1).cast("int")), "")
            return F.substring(there, (start - block * TEXT_BLOCK + 1).cast("int"), (end - start).cast("int"))

        return body(cut)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0)), with_blocks)


def members(keys: Column, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``body`` of a function that tells whether a long is among ``keys`` (distinct longs): they are dealt to as many buckets as
    the root of their number, and one is looked through."""

    def with_keys(own: Column) -> Column:
        count = F.greatest(F.ceil(F.sqrt(F.size(own))).cast("long"), F.lit(1).cast("long"))
        buckets = F.transform(numbers(count, 0), lambda b: F.filter(own, lambda k: F.pmod(k, count) == b))

        def with_buckets(known: Column) -> Column:
            return body(lambda x: F.array_contains(F.element_at(known, (F.pmod(x, F.size(known).cast("long")) + 1).cast("int")), x))

        return let(buckets, with_buckets)

    return let(keys, with_keys)


def sorted_members(keys: Column, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``body`` of a function that tells whether a long is among ``keys`` (longs), by halving the sorted array."""

    def with_keys(own: Column) -> Column:
        bits = F.ceil(F.log2(F.size(own) + 1)).cast("int")
        steps = F.transform(numbers(bits, 0), lambda k: F.call_function("shiftleft", F.lit(1), bits - 1 - k))

        def with_steps(step: Column) -> Column:
            def has(x: Column) -> Column:
                # how many keys are at most x: of powers of two, from the largest, those that fit
                reached = F.aggregate(step, F.lit(0), lambda at, n: F.when((at + n <= F.size(own)) & (F.try_element_at(own, at + n) <= x), at + n).otherwise(at))
                return F.coalesce(F.try_element_at(own, F.greatest(reached, F.lit(1))) == x, F.lit(False))

            return body(has)

        return let(steps, with_steps)

    return let(F.sort_array(keys), with_keys)
