"""Benchmark decontamination: random-walk embedding, repeated bit sampling over item-sized windows, edit verification."""

from __future__ import annotations

import math
import unicodedata
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidewater.llm.common import filter_rows, map_arrow, text_key, text_slices

#: Bytes of benchmark text that one pass over the documents looks for; more items take more passes.
BLOCK_BYTES = 256 << 10
#: Bytes of one text that are searched at once.
PIECE = 4 << 20
#: Longest grams of short items, and the length from which items are found by walks.
GRAM, WALK_FROM = 8, 64
#: Random walks, their rounds of three steps, the steps of each that are sampled, and the characters between starts in a text.
WALKS, ROUNDS, SAMPLED, STRIDE = 20, 10, 14, 4
#: Rounds after which a text's walk goes on only if one of the items has the same samples, and walks taken at once (as many as the caches hold).
EARLY, CHUNK = 7, 1 << 15
#: Places with equal keys that a window must hold, and how many of so many parts of its length they must lie in (short and long items).
NEED, SPREAD, PARTS, LONG = 4, (3, 4), 8, 128
#: Equal grams of a stretch of text and items that are held at once, about.
HITS = 1 << 21
_SLOTS = 20
#: Bits of a key for the diagonal; those above are the item.
_SHIFT = 41
_BLANK = 32
_rng = np.random.default_rng(8)
_FACTORS = _rng.integers(1, 1 << 31, GRAM, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: Each character, or a blank for all that stand between words: punctuation, symbols, blanks and controls.
_FOLD = np.arange(0x110000, dtype=np.uint32)
_FOLD[[i for i in range(0x110000) if unicodedata.category(chr(i))[0] in "PSZC"]] = _BLANK


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters of joined lower-case UTF-8 with one blank for all between words, and where each text begins in them."""
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _FOLD[points]
    word = out != _BLANK
    keep = word.copy()
    keep[1:] |= word[:-1]
    keep[:1] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[np.minimum(begins, len(keep))]


def _string(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def slots(points: np.ndarray, q: int) -> np.ndarray:
    """Hash of the gram of ``q`` characters from each place."""
    n = max(0, len(points) - q + 1)
    h = np.zeros(n, np.uint32)
    for j in range(q):
        h += points[j : j + n] * _FACTORS[j]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x9E3779B1)
    return h >> np.uint32(32 - _SLOTS)


def edit_distance(pattern: str, text: str) -> int:
    """Fewest edits between ``pattern`` and any part of ``text``, by bit vectors of the pattern's columns."""
    m = len(pattern)
    if not m:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for eq in map(masks.get, text, repeat(0)):
        diagonal = (((eq & up) + up) ^ up) | eq | down
        horizontal_up, horizontal_down = down | (full & ~(diagonal | up)), up & diagonal
        if horizontal_up & high:
            score += 1
        elif horizontal_down & high:
            score -= 1
            if score < best:
                best = score
        horizontal_up <<= 1
        up, down = horizontal_down << 1 & full | (full & ~(diagonal | horizontal_up)), horizontal_up & diagonal & full
    return best


class Walk:
    """A random walk over characters (CGK), of which some steps are sampled.

    At each step the walk emits the character that it stands on and, by a random bit drawn for the step and the character,
    stays or goes on to the next. Two texts that differ by an edit fall out of step there and in step again by chance, so
    their edit distance becomes a number of steps that differ. The sampled steps of a walk are its key. Three steps read
    three characters at most, so a table of all triples (five bits a character) takes them at once.
    """

    def __init__(self, seed: int):
        self.seed = seed
        rng = np.random.default_rng([8, seed])
        sampled = np.zeros(3 * ROUNDS, bool)
        sampled[rng.choice(3 * ROUNDS, SAMPLED, replace=False)] = True
        go = rng.integers(0, 2, (3 * ROUNDS, 32), dtype=np.uint32)
        value = rng.integers(0, 1 << 30, (3 * ROUNDS, 32), dtype=np.uint32).astype(np.int64)
        triples = np.stack([np.arange(1 << 15) >> shift & 31 for shift in (10, 5, 0)])
        self.rounds = []
        for first in range(0, 3 * ROUNDS, 3):
            place, key = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)
            for step in range(first, first + 3):
                here = triples[place, np.arange(1 << 15)]
                key += value[step, here] * sampled[step]
                place += go[step, here]
            self.rounds.append((key % (1 << 30)) << 32 | place)  # key above, characters gone below, so one sum adds both

    def __reduce__(self):
        return Walk, (self.seed,)  # the tables are drawn again where they are read

    def keys(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Key of the walk from each start, over the triples of :func:`triples`."""
        parts = [self._walked(codes, starts[first : first + CHUNK].copy(), 0, ROUNDS) for first in range(0, len(starts), CHUNK)]
        return _mixed(np.concatenate([np.zeros(0, np.int64), *parts]))

    def mark(self, codes: np.ndarray, starts: np.ndarray, early: np.ndarray) -> None:
        """Marks where the walk from each start is after ``EARLY`` rounds."""
        early[self._walked(codes, starts.copy(), 0, EARLY) >> 32 & len(early) - 1] = True

    def likely_keys(self, codes: np.ndarray, starts: np.ndarray, early: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The starts whose walk is after ``EARLY`` rounds where one of the marked walks is, by index, and their keys.

        Equal samples are equal from the first on, so most walks need not be walked to their end.
        """
        kept, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for first in range(0, len(starts), CHUNK):
            state = self._walked(codes, starts[first : first + CHUNK].copy(), 0, EARLY)
            near = np.flatnonzero(early.take(state >> 32 & len(early) - 1, mode="clip"))
            kept.append(first + near)
            parts.append(self._walked(codes, state[near], EARLY, ROUNDS))
        return np.concatenate(kept), _mixed(np.concatenate(parts))

    def _walked(self, codes: np.ndarray, state: np.ndarray, first: int, last: int) -> np.ndarray:
        """The states after some more rounds, in place."""
        here, there = np.empty(len(state), np.int64), np.empty(len(state), np.int64)
        for table in self.rounds[first:last]:
            np.bitwise_and(state, 0xFFFFFFFF, out=here)
            codes.take(here, out=there, mode="clip")  # no index is out of range, so clip checks least
            state += table.take(there, out=here, mode="clip")
        return state


def _mixed(state: np.ndarray) -> np.ndarray:
    """The keys in walk states, well spread over 32 bits."""
    out = (state >> 32).astype(np.uint32)
    out *= np.uint32(0x9E3779B1)
    return out ^ out >> np.uint32(15)


def triples(points: np.ndarray) -> np.ndarray:
    """Five bits of each character and the two behind it; blanks follow the end."""
    c = np.concatenate([points & 31, np.zeros(3 * ROUNDS + 2, np.uint32)]).astype(np.uint16)
    return (c[:-2] << np.uint16(10) | c[1:-1] << np.uint16(5) | c[2:]).astype(np.int64)


class ItemTables:
    """Keys of a block of benchmark items.

    Where a text holds an item with edits, walks that start at the same place of both meet in many keys, and the diagonals
    of these (place in the text less place in the item) lie within ``most`` edits of one another, so an item-sized window
    holds them. Windows with ``need`` equal keys or more are verified. Walks start at every place of an item and at every
    ``STRIDE``-th of a text, since over a whole item two walks are seldom in step at one edit in five.

    An item of fewer than ``WALK_FROM`` characters has too few starts. It is found by disjoint grams instead: each edit
    spoils one at most, so of ``most + need`` grams ``need`` are always met.
    """

    def __init__(self, items: list[tuple[int, str]], similarity: float):
        if not 0 < similarity <= 1:
            raise ValueError("similarity must be above 0 and at most 1")
        self.items, points = [], []
        for item_id, text in items:
            raw = pc.utf8_lower(pa.scalar(text)).as_py().encode("utf-8", "surrogatepass")
            clean = _string(fold(np.frombuffer(raw, np.uint8), np.zeros(1, np.int64))[0]).strip(" ")
            if clean:
                self.items.append((item_id, clean, len(clean), math.floor(len(clean) * (1 - similarity) + 1e-9)))
                points.append(np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), np.uint32))
        self.length, self.most = (np.array([i[k] for i in self.items], np.int64) for k in (2, 3))
        self.longest, self.widest = int(self.length.max(initial=0)), int(self.most.max(initial=0))
        self.reach = self.longest + 2 * self.widest + 3 * ROUNDS
        self.gap = self.longest + self.widest + 1  # between the diagonals of texts
        plans = [self._plan(n, most) for _, _, n, most in self.items]
        self.need = np.array([need for _, need in plans], np.int64)
        self.spread = np.array([1 if q else SPREAD[int(n >= LONG)] for (q, _), n in zip(plans, self.length, strict=True)])
        self.whole = [[(q, np.unique(slots(p, q)[::q])) for q in (4, 3)] for p in points]
        self._seen = np.zeros(1 << _SLOTS, bool)
        self.walks = self._walk_tables([k for k, (q, _) in enumerate(plans) if not q], points)
        self.tables = {}
        for q in sorted({q for q, _ in plans if q}):
            often = np.bincount(np.concatenate([slots(p, q) for p in points]), minlength=1 << _SLOTS)
            slot, entry = [], []
            for k in [k for k, plan in enumerate(plans) if plan[0] == q]:
                n, hashes = len(points[k]), slots(points[k], q)
                best = min(range(n % q + 1), key=lambda phase: often[hashes[phase::q][: n // q]].sum())
                places = best + q * np.arange(n // q)
                places = places[np.argsort(often[hashes[places]], kind="stable")][: int(self.most[k]) + plans[k][1]]
                slot.append(hashes[places])
                entry.append((k << _SHIFT) + self.longest - places)
            slot, entry = np.concatenate(slot), np.concatenate(entry).astype(np.int64)
            order = np.argsort(slot, kind="stable")
            count = np.bincount(slot, minlength=1 << _SLOTS).astype(np.int32)
            self.tables[q] = (count > 0, count, (np.cumsum(count) - count).astype(np.int32), entry[order])

    def __getstate__(self) -> dict:
        """Without what is empty or drawn from a seed, and a bit for each mark, as every executor keeps a copy on its disk."""
        walks = [(walk, np.packbits(early), np.packbits(known), *rest) for walk, early, known, *rest in self.walks]
        return {k: v for k, v in self.__dict__.items() if k != "_seen"} | {"walks": walks}

    def __setstate__(self, state: dict) -> None:
        walks = [(walk, np.unpackbits(early).view(bool), np.unpackbits(known).view(bool), *rest) for walk, early, known, *rest in state["walks"]]
        self.__dict__.update(state, walks=walks, _seen=np.zeros(1 << _SLOTS, bool))

    def _walk_tables(self, own: list[int], points: list[np.ndarray]) -> list[tuple]:
        """For each walk: itself, a mark for the low part of each early key and of each key, the distinct keys, where their entries begin, entries."""
        if not own:
            return []
        codes = [triples(points[k]) for k in own]
        # A walk that runs far over the end of an item meets no text.
        starts = [np.arange(len(points[k]) - ROUNDS) for k in own]
        entry = np.concatenate([(k << _SHIFT) + self.longest - at for k, at in zip(own, starts, strict=True)])
        bits = max(16, int(len(entry) * 16 - 1).bit_length())
        out = []
        for seed in range(WALKS):
            walk = Walk(seed)
            key = np.concatenate([walk.keys(c, at) for c, at in zip(codes, starts, strict=True)])
            order = np.argsort(key, kind="stable")
            distinct, first = np.unique(key[order], return_index=True)
            known, early = np.zeros(1 << bits, bool), np.zeros(1 << bits, bool)
            known[distinct & np.uint32((1 << bits) - 1)] = True
            for c, at in zip(codes, starts, strict=True):
                walk.mark(c, at, early)
            out.append((walk, early, known, distinct, np.append(first, len(key)), entry[order]))
        return out

    def _plan(self, n: int, most: int) -> tuple[int, int]:
        """Size of the grams, 0 for walks, and how many equal keys must be met."""
        if n >= WALK_FROM:
            return 0, NEED
        for need in (4, 2, 1) if n >= 40 else (2, 1) if n >= 12 else (1,):
            for q in range(min(GRAM, n), 0, -1):  # the longest grams of which enough are left after the edits
                if n // q - most >= need:
                    return q, need
        raise AssertionError("single characters are always left")

    def _met(self, points: np.ndarray, begin: int, end: int):
        """Places of ``points[begin:end]`` and their entries, as runs, for each gram size and for all walks together."""
        for q, (known, count, start, entry) in self.tables.items():
            slot = slots(points[begin:end], q)
            hit = np.flatnonzero(known[slot])
            yield [(begin + hit, start[slot[hit]], count[slot[hit]].astype(np.int64), entry)]
        if self.walks:
            codes, starts, out = triples(points[begin:end]), np.arange(-begin % STRIDE, end - begin, STRIDE), []
            for walk, early, known, distinct, first, entry in self.walks:
                likely, key = walk.likely_keys(codes, starts, early)
                maybe = np.flatnonzero(known.take(key & np.uint32(len(known) - 1)))
                likely, key = likely[maybe], key[maybe]
                at = np.minimum(np.searchsorted(distinct, key), len(distinct) - 1)
                equal = distinct[at] == key
                at = at[equal]
                out.append((begin + starts[likely[equal]], first[at], first[at + 1] - first[at], entry))
            yield out

    def _keys(self, points: np.ndarray, places: np.ndarray, begin: int, end: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Item with diagonal, and place, of enough equal keys, for each stretch and kind of key."""
        found = []
        for runs in self._met(points, begin, end):
            total = int(sum(n.sum() for _, _, n, _ in runs))
            if total > HITS and end - begin > 4 * self.reach:
                middle = (begin + end) // 2
                return self._keys(points, places, begin, middle + self.reach) + self._keys(points, places, middle, end)
            if not total:
                continue
            parts = []
            for hit, start, n, entry in runs:
                at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                place = np.repeat(places[hit], n)
                parts.append((entry[at] + place, place))
            keys, place = (np.concatenate(p) for p in zip(*parts, strict=True))
            order = np.lexsort((place, keys))
            keys, place = keys[order], place[order]
            # Equal keys of several walks at one place count once.
            fresh = np.concatenate([[True], (np.diff(keys) > 0) | (np.diff(place) > 0)])
            keys, place, total = keys[fresh], place[fresh], int(fresh.sum())
            item = keys >> _SHIFT
            last = np.arange(total) + self.need[item] - 1
            near = (last < total) & (keys[np.minimum(last, total - 1)] - keys <= self.most[item])
            # All keys of a window that holds enough of them.
            ends = np.cumsum(np.bincount(np.flatnonzero(near), minlength=total) - np.bincount(last[near] + 1, minlength=total + 1)[:total])
            found.append((keys[ends > 0], place[ends > 0]))
        return found

    def _enough(self, near: np.ndarray, q: int, whole: np.ndarray, enough: int) -> bool:
        """Whether ``near`` holds so many of the grams of ``q`` characters in ``whole``."""
        own = slots(near, q)
        self._seen[own] = True
        count = np.count_nonzero(self._seen[whole])
        self._seen[own] = False
        return count >= enough

    def search(self, points: np.ndarray, begins: np.ndarray) -> dict[tuple[int, int], int]:
        """Least distance of each text of folded characters and item that it holds."""
        best: dict[tuple[int, int], int] = {}
        if not len(points) or not self.items:
            return best
        rows = len(begins) - 1
        places = np.arange(len(points)) + np.repeat(np.arange(rows) * self.gap, np.diff(begins))
        found = self._keys(points, places, 0, len(points))
        keys, place = (np.concatenate(p) for p in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        if not len(keys):
            return best
        order = np.argsort(keys)
        keys, place = keys[order], place[order]
        item, at = keys >> _SHIFT, (keys & ((1 << _SHIFT) - 1)) - self.longest
        row = np.searchsorted(begins[:-1] + np.arange(rows) * self.gap - self.longest, at, "right") - 1
        at -= row * self.gap
        # Neighbouring diagonals are read as one stretch, if its keys lie in enough parts of an item.
        fresh = np.flatnonzero(np.concatenate([[True], (np.diff(item) > 0) | (np.diff(row) > 0) | (np.diff(at) > self.most[item[1:]])]))
        last = np.append(fresh[1:], len(keys)) - 1
        parts = np.bitwise_or.reduceat(np.uint64(1) << (place * PARTS // self.length[item] % 64).astype(np.uint64), fresh)
        wide = np.bitwise_count(parts) >= self.spread[item[fresh]]
        fresh, last = fresh[wide], last[wide]
        for i, j in zip(fresh, last, strict=True):
            r, k = int(row[i]), int(item[i])
            if best.get((r, k)) == 0:
                continue
            _, text, n, most = self.items[k]
            near = points[max(begins[r], at[i] - most) : min(begins[r + 1], at[j] + n + most)]
            # Each edit spoils one of the disjoint grams at most; equal ones are counted once.
            if any(len(whole) > most and not self._enough(near, q, whole, len(whole) - most) for q, whole in self.whole[k]):
                continue
            part = _string(near)
            distance = 0 if text in part else edit_distance(text, part)
            if distance <= most:
                best[r, k] = min(distance, best.get((r, k), distance))
        return best


def matches(tables: ItemTables, data: np.ndarray, offsets: np.ndarray):
    """Items found in joined lower-case texts: (row, item, distance), the least distance of each row and item."""
    for (row, item), distance in tables.search(*fold(data, offsets)).items():
        yield row, item, distance


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Documents that hold a benchmark item (item_id, text), or nearly: one row for each document and item.

    Case and everything between words are ignored. An item is held if some part of the text is at an edit distance,
    in characters, of at most 1 - ``similarity`` of the item's length, be it within a word. Candidates come from the
    tables: grams miss none of short items, walks find the others with a high probability that depends on the edits
    (README); every one is verified. Items without letters or digits cannot be found. The items are looked
    for in blocks of bounded size, one pass over the documents each. Gives doc_id, text_key, item_id, distance, similarity.
    Missing texts hold nothing; a missing item_id is given as -1; repeated rows give repeated rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), F.col("text").cast("string"))
    parts = [map_arrow(rows, _search(tables), "doc_id long, text_key long, item_id long, distance int, similarity double") for tables in _blocks(benchmark, similarity)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _blocks(benchmark: DataFrame, similarity: float) -> list:
    """Tables of the items, in broadcast blocks of about ``BLOCK_BYTES``."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks, out = max(1, math.ceil(size / BLOCK_BYTES)), []
    for b in range(blocks):
        held = items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == b).collect()  # about BLOCK_BYTES
        tables = ItemTables(sorted((r.item_id if r.item_id is not None else -1, r.text) for r in held), similarity)
        out.append(benchmark.sparkSession.sparkContext.broadcast(tables))
    return out


def _found(tables: ItemTables, batch: pa.RecordBatch) -> dict[tuple[int, int], int]:
    """Least distance of each row of a batch and item that it holds."""
    out: dict[tuple[int, int], int] = {}
    for first, last, data, offsets in text_slices(pc.utf8_lower(pc.fill_null(batch.column("text"), "")), 1 << 19):
        if last - first > 1 or len(data) <= PIECE:
            out.update({(first + row, item): distance for row, item, distance in matches(tables, data, offsets)})
            continue
        begin, held = 0, np.zeros(0, np.uint32)
        while begin < len(data):  # a long text is searched piece by piece, the end of one before the next
            end = min(len(data), begin + PIECE)
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
            points = fold(data[begin:end], np.zeros(1, np.int64))[0]
            if len(held) and held[-1] == _BLANK == points[0]:
                points = points[1:]
            points = np.concatenate([held, points])
            for (_, item), distance in tables.search(points, np.array([0, len(points)])).items():
                out[first, item] = min(distance, out.get((first, item), distance))
            begin, held = end, points[-tables.reach :]
    return out


def _search(shared):
    def run(batches):
        tables = shared.value
        for batch in batches:
            if out := _found(tables, batch):
                rows, found = pa.array([r for r, _ in out]), [tables.items[i] for _, i in out]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), batch.column("text_key").take(rows), pa.array([i[0] for i in found], pa.int64()),
                     pa.array(list(out.values()), pa.int32()), pa.array([1 - d / len(i[1]) for d, i in zip(out.values(), found, strict=True)])],
                    names=["doc_id", "text_key", "item_id", "distance", "similarity"])

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns; missing and empty texts stay."""
    for shared in _blocks(benchmark, similarity):
        docs = filter_rows(docs, _clean(shared))
    return docs


def _clean(shared):
    def keep():
        def decide(batch):
            bad = {row for row, _ in _found(shared.value, batch)}
            return [row not in bad for row in range(batch.num_rows)]

        return decide

    return keep
