"""Folds that depend on order, over sorted runs with carried state.

Rows of a key arrive together and in order, and a task reads them as a stream: it holds the
state of the current key only, never a key's rows.  A run may cross Arrow batches.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator
from math import floor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .. import constants as C

Offer = tuple  # price, stock, updated


def stream(df: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Callable, step: Callable, end: Callable, schema: str) -> DataFrame:
    """``start(key)`` a state, ``step(state, *columns)`` for each row, ``end(key, state)`` the result rows of a key.

    ``start`` gives a mutable state, or ``step`` returns the next one.  Times among ``columns`` come as microseconds.
    """
    rows = _sorted(df, keys, order, columns)
    width = len(schema.split(", "))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        kinds = None
        for batch in batches:
            out = []
            ids = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
            values = zip(*(_plain(batch.column(c)).to_pylist() for c in columns), strict=True)
            for key, row in zip(ids, values, strict=True):
                if key != held:
                    if held is not None:
                        out += end(held, state)
                    held, state = key, start(key)
                state = step(state, *row)
            if kinds is None:
                kinds = _arrow(schema)
            if out:
                yield _batch(out, kinds, width)
        if held is not None:
            yield _batch(end(held, state), kinds, width)

    return rows.mapInArrow(run, schema)


def _sorted(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Keys and columns, a key's rows together and in order."""
    rows = df.select(*dict.fromkeys([*keys, *order, *columns])).repartition(*keys).sortWithinPartitions(*keys, *order)
    return rows.select(*dict.fromkeys([*keys, *columns]))


def _plain(column: pa.Array) -> pa.Array:
    return column.cast(pa.int64()) if pa.types.is_timestamp(column.type) else column


def _arrow(schema: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "timestamp": pa.timestamp("us", tz="UTC"), "boolean": pa.bool_()}
    return [(f.rsplit(" ", 1)[0], kinds[f.rsplit(" ", 1)[1]]) for f in schema.split(", ")]


def _batch(rows: list[tuple], kinds: list[tuple[str, pa.DataType]], width: int) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * width
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def replaces(held: Offer, new: Offer) -> bool:
    """A later offer is merged over the held one: it is cheaper, or in stock where that is not.

    This and the next two take offers, or columns of them.
    """
    return (new[0] < held[0]) | ((held[1] == "out-of-stock") & (new[1] != "out-of-stock"))


def replaces_or_newer(held: Offer, new: Offer) -> bool:
    return replaces(held, new) | (new[2] > held[2])


def beats(held: Offer, new: Offer) -> bool:
    """A later offer of a store takes the place of its best one."""
    return replaces(held, new) | ((new[0] == held[0]) & (new[2] > held[2]))


def fold_offers(offers: DataFrame, keys: list[str], order: list[str], better: Callable[[Offer, Offer], bool]) -> DataFrame:
    """The offer (price, stock, updated) that a fold in the given order leaves per key.

    An offer that does not beat the one before it does not beat what is held by then either, be that the one before or one
    which that did not beat.  So such offers go, whole columns at a time, until each beats the one before: then all are
    taken, and the last one stays.  ``better`` must be such a rule, and work on columns.
    """
    columns = ["price", "stock", "updated"]
    schema = ", ".join(f"{c} {kind}" for c in [*keys, *columns] for kind in [dict(offers.dtypes)[c]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            place = _run_numbers([rows.column(k) for k in keys])
            at = _standing(place, [_plain(rows.column(c)).to_numpy() for c in columns], better)
            ends = at[np.append(np.diff(place[at]) > 0, True)]
            if len(ends) > 1:
                yield from rows.take(pa.array(ends[:-1])).combine_chunks().to_batches()
            held = rows.slice(ends[-1], 1).combine_chunks().to_batches()[0]
        if held is not None:
            yield held

    return _sorted(offers, keys, order, columns).mapInArrow(run, schema)


def _run_numbers(keys: list[pa.ChunkedArray]) -> np.ndarray:
    """Per row the number of its run of equal keys; null is a key."""
    new = np.zeros(len(keys[0]), dtype=bool)
    for key in keys:
        a, b = key.slice(0, len(key) - 1), key.slice(1)
        other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new[1:] |= other.to_numpy()
    return np.cumsum(new)


def _standing(place: np.ndarray, columns: list[np.ndarray], better: Callable) -> np.ndarray:
    """Rows that a fold takes, run by run; where few go in a round, the rest is told row by row."""
    at, ordered = np.arange(len(place)), not any(c.dtype.kind == "f" and np.isnan(c).any() for c in columns)
    while len(at) > 1:
        before, after = at[:-1], at[1:]
        if not ordered:
            break
        keep = (place[before] != place[after]) | better([c[before] for c in columns], [c[after] for c in columns]).astype(bool)
        gone = len(keep) - np.count_nonzero(keep)
        if not gone:
            return at
        at = at[np.append(True, keep)]
        ordered = gone * 16 > len(keep)
    taken, held, run = [], None, None
    for k, p, *new in zip(at.tolist(), place[at].tolist(), *(c[at].tolist() for c in columns), strict=True):
        if p != run or better(held, new):
            run, held = p, new
            taken.append(k)
    return np.array(taken, dtype=np.int64)


def comparable(offers: Iterable[tuple]) -> list[tuple]:
    """Offers (store, price, stock, updated) that compare, cheapest first: the best of each store without outliers."""
    best: dict[str, tuple] = {}
    for offer in offers:
        store = (offer[0] or "").lower()
        if store and offer[1] > 0 and (store not in best or beats(best[store][1:], offer[1:])):
            best[store] = offer
    kept = sorted(best.values(), key=lambda o: o[1])
    prices = [o[1] for o in kept]
    if len(kept) < 2:
        return kept
    if len(kept) == 2:
        apart = prices[1] / max(prices[0], 1) >= C.PAIR_RATIO and prices[1] - prices[0] >= C.PAIR_MIN_DELTA
        return kept[:1] if apart else kept
    half = len(prices) // 2
    median = prices[half] if len(prices) % 2 else (prices[half - 1] + prices[half]) / 2
    least = max(C.MIN_DELTA, floor(median * C.RELATIVE_DELTA + 0.5))
    above = lambda p: p / median >= C.UPPER_RATIO and p - median >= least
    below = lambda p: p / median <= C.LOWER_RATIO and median - p >= least
    return [o for o in kept if not (above(o[1]) or below(o[1]))] or kept


def merged(held: list[tuple], new: list[tuple], newer_wins: bool) -> list[tuple]:
    """The comparable offers after one product's offers are merged over those held, store by store."""
    better = replaces_or_newer if newer_wins else replaces
    by_store = {o[0]: o for o in held}
    for offer in new:
        if offer[0] not in by_store or better(by_store[offer[0]][1:], offer[1:]):
            by_store[offer[0]] = offer
    return comparable(by_store.values())


class Sorted:
    """Distinct values in order, in blocks of bounded size, so that a change moves the values of one block only."""

    SIZE = 1_000

    def __init__(self, values: Iterable) -> None:
        values = sorted(values)
        self.blocks = [values[k : k + self.SIZE] for k in range(0, len(values), self.SIZE)]
        self.tops = [b[-1] for b in self.blocks]

    def add(self, value) -> None:
        if not self.blocks:
            self.blocks, self.tops = [[value]], [value]
            return
        k = min(bisect_left(self.tops, value), len(self.tops) - 1)
        block = self.blocks[k]
        insort(block, value)
        if len(block) > 2 * self.SIZE:
            self.blocks[k : k + 1] = block[: self.SIZE], block[self.SIZE :]
            self.tops[k : k + 1] = block[self.SIZE - 1], block[-1]
        else:
            self.tops[k] = block[-1]

    def remove(self, value) -> None:
        k = bisect_left(self.tops, value)
        block = self.blocks[k]
        del block[bisect_left(block, value)]
        if block:
            self.tops[k] = block[-1]
        else:
            del self.blocks[k], self.tops[k]

    def __getitem__(self, place: int):
        for block in self.blocks:
            if place < len(block):
                return block[place]
            place -= len(block)
        raise IndexError(place)

    def first(self):
        return self.blocks[0][0]

    def last(self):
        return self.tops[-1]


def _lower(store: str | None) -> str:
    """The store's name in small letters, as the same text where it is that."""
    low = (store or "").lower()
    return store if low == store else low


class Held:
    """Comparable offers of a key that more products are merged over, as ``merged`` does.

    A merge costs what the new offers do, however many are held: prices stand in order, the median is looked up among
    them, and outliers are at their ends.  ``changes`` are the offers that the last merge took in (True) or out (False),
    in that order, and ``places`` their prices and stores as they stand in order.
    """

    __slots__ = ("by_store", "prices", "changes", "places")

    def __init__(self, offers: list[tuple]) -> None:
        self.by_store = {_lower(o[0]): o for o in offers}
        self.prices = Sorted((o[1], s) for s, o in self.by_store.items())
        self.changes: list[tuple[bool, tuple]] = []
        self.places: list[tuple] = []

    def __len__(self) -> int:
        return len(self.by_store)

    def __iter__(self) -> Iterator[tuple]:
        return (self.by_store[s] for block in self.prices.blocks for _, s in block)

    def least(self) -> float:
        return self.prices.first()[0]

    def _put(self, store: str, offer: tuple | None) -> None:
        before = self.by_store.pop(store, None)
        if before is not None:
            place = (before[1], store)
            self.prices.remove(place)
            self.changes.append((False, before))
            self.places.append(place)
        if offer is not None:
            place = (offer[1], store)
            self.by_store[store] = offer
            self.prices.add(place)
            self.changes.append((True, offer))
            self.places.append(place)

    def merge(self, new: list[tuple], newer_wins: bool) -> None:
        self.changes, self.places = [], []
        stores = [_lower(o[0]) for o in new]
        if len(set(stores)) < len(stores):
            self._merge_several(new, replaces_or_newer if newer_wins else replaces)
        else:
            self._merge_singles(stores, new, newer_wins)
        self._compare()

    def _merge_singles(self, stores: list[str], new: list[tuple], newer_wins: bool) -> None:
        """Offers of which each store has one, as products mostly have."""
        for store, offer in zip(stores, new, strict=True):
            before = self.by_store.get(store)
            if before is None:
                if store and offer[1] > 0:
                    self._put(store, offer)
            elif before[0] != offer[0]:
                if offer[1] > 0 and beats(before[1:], offer[1:]):
                    self._put(store, offer)
            elif offer[1] < before[1] or (before[2] == "out-of-stock" != offer[2]) or (newer_wins and offer[3] > before[3]):
                self._put(store, offer if offer[1] > 0 else None)

    def _merge_several(self, new: list[tuple], better: Callable) -> None:
        own: dict = {}
        for offer in new:
            held = own.get(offer[0]) or self.by_store.get((offer[0] or "").lower())
            if held is None or held[0] != offer[0] or better(held[1:], offer[1:]):
                own[offer[0]] = offer
        stores: dict[str, list[tuple]] = {}
        for name, offer in own.items():
            stores.setdefault((name or "").lower(), []).append(offer)
        for store, offers in stores.items():
            before = self.by_store.get(store)
            if before is not None:  # a name in other letters is the same store, and comes after the name that is held
                offers = [own.get(before[0], before), *(o for o in offers if o[0] != before[0])]
            best = None
            for offer in offers:
                if store and offer[1] > 0 and (best is None or beats(best[1:], offer[1:])):
                    best = offer
            if best is not before:
                self._put(store, best)

    def _compare(self) -> None:
        """Take out what does not compare; an upper middle price is under twice the median, so some offer stays."""
        n, prices = len(self), self.prices
        if n == 2:
            low, high = prices.first()[0], prices.last()[0]
            if high / max(low, 1) >= C.PAIR_RATIO and high - low >= C.PAIR_MIN_DELTA:
                self._put(prices.last()[1], None)
        if n <= 2:
            return
        median = prices[n // 2][0] if n % 2 else (prices[n // 2 - 1][0] + prices[n // 2][0]) / 2
        least = max(C.MIN_DELTA, floor(median * C.RELATIVE_DELTA + 0.5))
        while (p := prices.last()[0]) / median >= C.UPPER_RATIO and p - median >= least:
            self._put(prices.last()[1], None)
        while (p := prices.first()[0]) / median <= C.LOWER_RATIO and median - p >= least:
            self._put(prices.first()[1], None)


def merged_over(held: list[tuple] | Held, new: list[tuple], newer_wins: bool) -> Held:
    """``merged``, with what is held kept in order for further merges."""
    if isinstance(held, Held):
        held.merge(new, newer_wins)
        return held
    return Held(merged(held, new, newer_wins))


def fold_products(offers: DataFrame, keys: list[str], newer_wins: bool, compare_first: bool = False, compare_single: bool = True) -> DataFrame:
    """Offers of each key after its products are merged one by one: keys, store_id, price, stock, updated.

    ``offers``: keys, seq (the product's place), place (the offer's), store_id, price, stock, updated.  Each merge
    compares what it leaves.  With ``compare_first`` the first product's outliers go before anything is merged over it,
    else they stand until then; a product that stays alone is compared unless ``compare_single`` is off, for offers that
    have been compared before.  A key's state is one offer per store.
    """
    kinds = dict(offers.dtypes)
    schema = ", ".join([*(f"{k} {'long' if kinds[k] == 'bigint' else kinds[k]}" for k in keys), "store_id string, price double, stock string, updated timestamp"])

    def step(state, seq, store_id, price, stock, updated):
        if state["seq"] != seq:
            _close(state, newer_wins, compare_first)
            state["seq"] = seq
        if store_id is not None and price is not None:
            state["new"].append((store_id, price, state["once"].setdefault(stock, stock), updated))
        return state

    def end(key, state):
        _close(state, newer_wins, compare_first)
        alone = comparable if state["alone"] and compare_single and not compare_first else list
        return [(*key, *offer) for offer in alone(state["held"] or ())]

    columns = ["seq", "store_id", "price", "stock", "updated"]
    typed = offers.withColumns({"store_id": offers["store_id"].cast("string"), "price": offers["price"].cast("double")})
    return stream(typed, keys, ["seq", "place"], columns, lambda key: {"seq": None, "held": None, "new": [], "alone": True, "once": {}}, step, end, schema)


def _close(state: dict, newer_wins: bool, compare_first: bool) -> None:
    """Merge the offers of the product that has ended."""
    if state["seq"] is not None:
        first = comparable if compare_first else list
        state["alone"] = state["held"] is None
        state["held"] = first(state["new"]) if state["alone"] else merged_over(state["held"], state["new"], newer_wins)
    state["new"] = []
