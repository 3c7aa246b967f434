"""Alignments of query landmarks with an index that every task holds whole.

Rows come as in :mod:`spinledger.operators.matching`, all landmarks of a query in one task
and in succession, or as whole queries that an :class:`Extractor` makes landmarks of there. A task looks its landmarks up in the index and counts there, one Arrow
batch of queries at a time: no hit becomes a row. Queries are taken together up to
:data:`MEETINGS` (query landmark, index landmark) pairs; one that has more by itself is
counted for a part of the tracks at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from spinledger.config import FingerprintConfig

#: Pairs of landmarks that are counted at once.
MEETINGS = 1 << 18
#: Query landmarks that are looked up at once.
LANDMARKS = 1 << 16
#: Most places of a table that finds index keys by ratio bin; beyond, they are searched.
TABLE = 1 << 22
OWN = ("query_id", "schema_id", "track_id", "query_hashes", "track_hashes")
_RATIOS = 1 << 34  # above any ratio bin with its tolerance, counted from _LOWEST
_LOWEST = 1 << 32


@lru_cache(maxsize=4096)
def steps(delta: int, tolerance: int, scales: tuple[float, ...]) -> list[dict]:
    """The index frame distances a query distance may hit, each with its (scale, step) pairs."""
    found: dict[int, list[dict]] = {}
    for scale in scales:
        for step in range(-tolerance, tolerance + 1):
            key = max(1, round(delta * scale)) + step
            if key >= 1:
                found.setdefault(key, []).append({"tempo_scale": scale, "time_step": step})
    return [{"key": key, "variants": variants} for key, variants in found.items()]


def _runs(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before it in any column, and for the first row."""
    first = np.zeros(len(columns[0]), dtype=bool)
    first[:1] = True
    for c in columns:
        first[1:] |= c[1:] != c[:-1]
    return first


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers ``start .. start + count - 1`` of every range, one range after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the number of each value among them."""
    low = int(values.min()) if len(values) else 0
    if not len(values) or int(values.max()) - low >= max(TABLE, len(values)):
        return np.unique(values, return_inverse=True)
    there = np.zeros(int(values.max()) - low + 1, dtype=bool)
    there[values - low] = True
    return np.flatnonzero(there) + low, (np.cumsum(there) - 1)[values - low]


def _changes(column: pa.Array) -> np.ndarray:
    """:func:`_runs` of an Arrow column of any type; nulls are equal."""
    first = np.ones(len(column), dtype=bool)
    if len(column) > 1:
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False)
        first[1:] = pc.or_(differ, pc.not_equal(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return first


@dataclass(frozen=True)
class Extractor:
    """``make`` gives the landmarks of rows that each hold a whole query; ``schema`` names their columns."""

    make: Callable[[pa.RecordBatch], Iterator[pa.Table]]
    schema: str

    def landmarks(self, rows: DataFrame) -> DataFrame:
        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for table in self.make(batch):
                    yield from table.to_batches()

        return rows.mapInArrow(made, self.schema)


class Index:
    """Index landmarks in order of schema, frame distance and ratio bin, then track and landmark."""

    def __init__(self, rows: pa.Table) -> None:
        rows = rows.combine_chunks()
        column = lambda name: rows[name].to_numpy()
        schema = rows["schema_id"].combine_chunks().dictionary_encode()
        self.schemas = {s: i for i, s in enumerate(schema.dictionary.to_pylist())}
        names = rows["track_id"].combine_chunks().dictionary_encode()
        named, of_schema = names.indices.to_numpy(), schema.indices.to_numpy()
        _, first, track = np.unique(
            named.astype(np.int64) * max(1, len(self.schemas)) + of_schema, return_index=True, return_inverse=True
        )
        self.track_id, self.track_schema = names.dictionary.take(pa.array(named[first])), schema.dictionary.take(pa.array(of_schema[first]))
        self.track_hashes = rows["track_hashes"].combine_chunks().take(pa.array(first))
        delta = column("delta_frames").astype(np.int64)
        place = of_schema.astype(np.int64) * (1 << 33) + delta
        places, at = np.unique(place, return_inverse=True)
        self.places = {(int(p) >> 33, int(p) & ((1 << 33) - 1)): i for i, p in enumerate(places)}
        self._sorted(at * _RATIOS + column("ratio_bin").astype(np.int64) + _LOWEST, track, column("hash_index").astype(np.int64), column("anchor_frame").astype(np.int64))

    def _sorted(self, code: np.ndarray, track: np.ndarray, mark: np.ndarray, anchor: np.ndarray) -> None:
        order = np.lexsort((mark, track, code))
        self.code, self.track, self.mark, self.anchor = code[order], track[order], mark[order], anchor[order]
        self.start = np.flatnonzero(_runs(self.code))
        self.key, self.count = self.code[self.start], np.diff(np.append(self.start, len(self.code)))
        place, ratio = np.divmod(self.key, _RATIOS)
        self.low, self.wide = (int(ratio.min()), int(np.ptp(ratio)) + 1) if len(ratio) else (0, 1)
        self.table = None
        if len(self.places) * self.wide <= TABLE:
            self.table = np.full(len(self.places) * self.wide, -1, dtype=np.int32)
            self.table[place * self.wide + ratio - self.low] = np.arange(len(self.key))

    def find(self, place: np.ndarray, ratio: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where there is none. ``place``: 0 and more."""
        if not len(self.key):
            return np.full(len(place), -1)
        ratio = ratio + _LOWEST
        if self.table is None:
            code = place * _RATIOS + ratio
            at = np.minimum(np.searchsorted(self.key, code), len(self.key) - 1)
            return np.where(self.key[at] == code, at, -1)
        ratio -= self.low
        inside = (ratio >= 0) & (ratio < self.wide)
        return np.where(inside, self.table[place * self.wide + np.where(inside, ratio, 0)], -1)

    def part(self, one: int, of: int) -> Index:
        """The landmarks of each ``of``-th track."""
        some = self.track % of == one
        part = object.__new__(Index)
        part.__dict__.update(self.__dict__)
        part._sorted(self.code[some], self.track[some], self.mark[some], self.anchor[some])
        return part


class Ways:
    """The ways from a query landmark to index keys: for each of its distances, ratio step by distance, in order."""

    def __init__(self, cfg: FingerprintConfig, scales: tuple[float, ...]) -> None:
        self.cfg, self.scales = cfg, scales
        self.known: dict[int, int] = {}
        self.rows: list[tuple[int, int, dict[float, int]]] = []
        self.starts: list[int] = []
        self.counts: list[int] = []

    def of(self, delta: np.ndarray) -> np.ndarray:
        """The number of each distance in ``starts`` and ``counts``."""
        distinct, inverse = np.unique(delta, return_inverse=True)
        for d in distinct.tolist():
            if d not in self.known:
                found = sorted((s["key"], {v["tempo_scale"]: v["time_step"] for v in s["variants"]}) for s in steps(d, self.cfg.delta_tolerance, self.scales))
                self.known[d] = len(self.starts)
                self.starts.append(len(self.rows))
                reach = range(-self.cfg.ratio_tolerance, self.cfg.ratio_tolerance + 1)
                self.rows += [(r, key, variants) for r in reach for key, variants in found]
                self.counts.append(len(self.rows) - self.starts[-1])
                self._table()
        return np.array([self.known[d] for d in distinct.tolist()], dtype=np.int64)[inverse]

    def _table(self) -> None:
        self.ratio = np.array([r for r, _, _ in self.rows], dtype=np.int64)
        #: The time step of each way at each scale; a way that a scale lacks has ``none``.
        self.none = self.cfg.delta_tolerance + 1
        self.time = np.array([[v.get(s, self.none) for _, _, v in self.rows] for s in self.scales], dtype=np.int64)

    def places(self, index: Index) -> np.ndarray:
        """The place of each way's key in ``index``, by schema; -1 where it has none."""
        return np.array([[index.places.get((s, key), -1) for _, key, _ in self.rows] for s in range(len(index.schemas))], dtype=np.int64).reshape(-1, len(self.rows))


class Queries:
    """Whole queries, sorted by query and landmark. ``mark`` numbers distinct (query, landmark) pairs."""

    def __init__(self, rows: pa.Table, index: Index, ways: Ways) -> None:
        first = _changes(rows["query_id"].combine_chunks())
        self.query = np.cumsum(first) - 1
        column = lambda name: rows[name].to_numpy().astype(np.int64)
        at, heads = column("query_index"), np.flatnonzero(first)
        if np.any((np.diff(at) < 0) & ~first[1:]):
            order = np.lexsort((at, self.query))
            rows, self.query, at = rows.take(pa.array(order)), self.query[order], at[order]
        self.query_id = rows["query_id"].combine_chunks().take(pa.array(heads))
        self.query_hashes = rows["query_hashes"].combine_chunks().take(pa.array(heads))
        self.mark = np.cumsum(_runs(self.query, at)) - 1
        self.anchor, self.ratio = column("anchor_frame"), column("ratio_bin")
        schema = rows["schema_id"].combine_chunks().dictionary_encode()
        known = np.array([index.schemas.get(s, -1) for s in schema.dictionary.to_pylist()], dtype=np.int64)
        self.schema = known[schema.indices.to_numpy()]
        self.distance = ways.of(np.maximum(column("delta_frames"), 0))


class Met:
    """Query landmarks with the index landmarks they meet, in order of landmark, ratio step, time step and index landmark.

    A distance's time steps rise with its keys at every scale, so that order holds at all of them.
    """

    def __init__(self, queries: Queries, rows: np.ndarray, way: np.ndarray, at: np.ndarray, index: Index, ways: Ways) -> None:
        """``at``: the key of ``index`` that each of ``rows`` meets by ``way``."""
        counts = index.count[at]
        self.queries, self.index, self.ways = queries, index, ways
        self.row, self.way = np.repeat(rows, counts), np.repeat(way, counts)
        self.hit = _ragged(index.start[at], counts)
        self.reference = index.anchor[self.hit]
        #: Pairs of query and track that meet, in order, and the number of each row's pair among them.
        self.pairs, self.pair = _numbered(queries.query[self.row] * len(index.track_id) + index.track[self.hit])

    def at_scale(self, s: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Alignments at a scale: offsets, first places in ``order``, votes; and ``order``, the first hit of each landmark in each.

        Alignments that have no more hits than ``floor`` says for their pair may be left out.
        """
        inside = np.flatnonzero(self.ways.time[s][self.way] != self.ways.none)
        scaled = np.rint(self.queries.anchor * self.ways.scales[s]).astype(np.int64)
        whole = len(inside) == len(self.row)
        row, pair, reference = (x if whole else x[inside] for x in (self.row, self.pair, self.reference))
        offset = reference - scaled[row]
        if not len(row):
            return offset, offset, offset, offset
        low, bits = offset.min(), int(len(row)).bit_length()
        reach = int(offset.max() - low) + 1
        if len(self.pairs) * reach < 1 << (63 - bits):
            packed = (pair * reach + (offset - low) << bits) | np.arange(len(row))
            packed.sort()
            order = packed & ((1 << bits) - 1)
            packed >>= bits
            first = _runs(packed)
        else:
            order = np.lexsort((offset, pair))
            first = _runs(pair[order], offset[order])
        if floor is not None:
            starts = np.flatnonzero(first)
            hits = np.diff(np.append(starts, len(order)))
            most = np.repeat(hits > floor[pair[order[starts]]], hits)
            order, first = order[most], first[most]
        mark = self.queries.mark[row[order]]
        kept = first.copy()
        kept[1:] |= mark[1:] != mark[:-1]
        order, starts = order[kept], np.flatnonzero(first[kept])
        votes = np.diff(np.append(starts, len(order)))
        return offset[order[starts]], starts, votes, order if whole else inside[order]

    def distinct_hits(self, starts: np.ndarray, counts: np.ndarray, order: np.ndarray) -> np.ndarray:
        """How many index landmarks each range of ``order`` names."""
        found = np.ones(len(starts), dtype=np.int64)
        many = np.flatnonzero(counts > 1)
        named = np.repeat(np.arange(len(many)), counts[many]) * len(self.index.code) + self.hit[order[_ragged(starts[many], counts[many])]]
        named.sort()
        found[many] = np.bincount(named[_runs(named)] // len(self.index.code), minlength=len(many))
        return found

    def named(self, pair: np.ndarray, columns: Sequence[str] = OWN) -> list[pa.Array]:
        """Columns of pairs that their query or track has."""
        query, track = (pa.array(x) for x in np.divmod(pair, len(self.index.track_id)))
        q, t = self.queries, self.index
        of = {
            "query_id": (q.query_id, query), "query_hashes": (q.query_hashes, query),
            "schema_id": (t.track_schema, track), "track_id": (t.track_id, track), "track_hashes": (t.track_hashes, track),
        }
        return [of[c][0].take(of[c][1]) for c in columns]


def _every(columns: list[str]) -> Callable[[Met], Iterator[list[pa.Array]]]:
    def every(met: Met) -> Iterator[list[pa.Array]]:
        for s, scale in enumerate(met.ways.scales):
            offset, starts, votes, order = met.at_scale(s)
            if len(starts):
                own = {"tempo_scale": np.full(len(starts), scale), "offset_frames": offset.astype(np.int32), "votes": votes}
                if "reference_hits" in columns:
                    own["reference_hits"] = met.distinct_hits(starts, votes, order)
                names = [c for c in columns if c not in own]
                found = dict(zip(names, met.named(met.pairs[met.pair[order[starts]]], names)))
                yield [found[c] if c in found else pa.array(own[c]) for c in columns]

    return every


def _best(min_votes: int) -> Callable[[Met], Iterator[list[pa.Array]]]:
    def best(met: Met) -> Iterator[list[pa.Array]]:
        votes = np.full(len(met.pairs), min_votes - 1, dtype=np.int64)
        scale, offset, reached = np.zeros(len(votes)), np.zeros(len(votes), dtype=np.int64), np.zeros(len(votes), dtype=np.int64)
        for s, value in enumerate(met.ways.scales):
            offsets, starts, counts, order = met.at_scale(s, votes)  # votes are distinct hits
            if not len(starts):
                continue
            # Most votes, then the alignment found first. Alignments stand in order of pairs.
            rank = (counts << 32) - order[starts]
            pair = met.pair[order[starts]]
            heads = np.flatnonzero(_runs(pair))
            top = np.maximum.reduceat(rank, heads)
            chosen = np.flatnonzero(rank == np.repeat(top, np.diff(np.append(heads, len(rank)))))
            better = counts[chosen] > votes[pair[chosen]]
            chosen = chosen[better]
            at = pair[chosen]
            votes[at], scale[at], offset[at] = counts[chosen], value, offsets[chosen]
            reached[at] = met.distinct_hits(starts[chosen], counts[chosen], order)
        some = votes >= min_votes
        yield [*met.named(met.pairs[some]), pa.array(scale[some]), pa.array(offset[some].astype(np.int32)), pa.array(votes[some]), pa.array(reached[some])]

    return best


def _hit_counts(met: Met) -> Iterator[list[pa.Array]]:
    found, inverse = _numbered(met.pair * len(met.ways.rows) + met.way)
    hits = np.bincount(inverse)
    pair, way = np.divmod(found, len(met.ways.rows))
    query, track = np.divmod(met.pairs[pair], len(met.index.track_id))
    ratio, times = met.ways.ratio[way], met.ways.time
    same: dict[bytes, list[float]] = {}  # scales at which every way takes the same time step
    for s, value in enumerate(met.ways.scales):
        same.setdefault(times[s].tobytes(), []).append(value)
    for steps_at, values in same.items():
        time = np.frombuffer(steps_at, dtype=times.dtype)[way]
        some = np.flatnonzero(time != met.ways.none)
        if not len(some):
            continue
        # Different ways of a query may lead to one step, so its hits are added up before queries are counted.
        order = some[np.lexsort((query[some], time[some], ratio[some], track[some]))]
        step = _runs(track[order], ratio[order], time[order])
        heads = np.flatnonzero(step)
        counted = np.add.reduceat(hits[order], heads)
        queries = np.add.reduceat((step | _runs(query[order])).astype(np.int64), heads)
        of = order[heads]
        for value in values:
            yield [
                met.index.track_schema.take(pa.array(track[of])), met.index.track_id.take(pa.array(track[of])), pa.array(np.full(len(of), value)),
                pa.array(ratio[of].astype(np.int32)), pa.array(time[of].astype(np.int32)), pa.array(counted), pa.array(queries),
            ]


def _meetings(queries: Queries, index: Index, ways: Ways) -> Iterator[Met]:
    """What meets, in pieces of whole queries, or of a query's tracks, of about :data:`MEETINGS` rows."""
    ways_of = np.array(ways.counts)[queries.distance]
    row = np.repeat(np.arange(len(queries.query)), ways_of)
    way = _ragged(np.array(ways.starts)[queries.distance], ways_of)
    schema = queries.schema[row]
    place = np.where(schema >= 0, ways.places(index)[schema, way], -1)
    some = place >= 0
    row, way = row[some], way[some]
    place, ratio = place[some], queries.ratio[row] + ways.ratio[way]
    found = index.find(place, ratio)
    some = found >= 0
    row, way, at, place, ratio = row[some], way[some], found[some], place[some], ratio[some]
    if not len(row):
        return
    query, counts = queries.query[row], index.count[at]
    heads = np.flatnonzero(_runs(query))
    met = np.add.reduceat(counts, heads)
    ends = np.append(heads[1:], len(row))
    # A query joins those before it while all of them together stay within the bound.
    first = 0
    while first < len(heads):
        last, total = first + 1, int(met[first])
        while last < len(heads) and total + met[last] <= MEETINGS:
            total += int(met[last])
            last += 1
        piece = slice(heads[first], ends[last - 1])
        if total <= MEETINGS:
            yield Met(queries, row[piece], way[piece], at[piece], index, ways)
        else:
            parts = min(-(-total // MEETINGS), len(index.track_id))
            for n in range(parts):
                part = index.part(n, parts)
                found = part.find(place[piece], ratio[piece])
                there = found >= 0
                if there.any():
                    yield Met(queries, row[piece][there], way[piece][there], found[there], part, ways)
        first = last


def _whole_queries(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
    """The rows in tables of whole queries: a table's last query waits for the next one."""
    waiting: list[pa.Table] = []
    held = 0
    for table in tables:
        waiting.append(table)
        held += table.num_rows
        if held >= LANDMARKS:
            rows = pa.concat_tables(waiting).combine_chunks()
            last = int(np.flatnonzero(_changes(rows["query_id"].combine_chunks()))[-1])
            if last:
                yield rows.slice(0, last).combine_chunks()
            waiting, held = [rows.slice(last)], rows.num_rows - last
    if held:
        yield pa.concat_tables(waiting).combine_chunks()


def _run(
    landmarks: DataFrame, index: pa.Table, cfg: FingerprintConfig, scales: tuple[float, ...],
    count: Callable[[Met], Iterator[list[pa.Array]]], schema: str, extractor: Extractor | None,
) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    shared = landmarks.sparkSession.sparkContext.broadcast(index.drop_null())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not shared.value.num_rows:
            return
        table, ways = Index(shared.value), Ways(cfg, scales)
        if extractor is None:
            tables = (pa.Table.from_batches([batch]) for batch in batches)
        else:
            tables = (made for batch in batches for made in extractor.make(batch))
        for rows in _whole_queries(tables):
            for met in _meetings(Queries(rows, table, ways), table, ways):
                for columns in count(met):
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    if extractor is not None:
        return landmarks.mapInArrow(counted, schema)
    needed = ["query_id", "schema_id", "query_index", "anchor_frame", "ratio_bin", "delta_frames", "query_hashes"]
    return landmarks.select(*needed).dropna(subset=needed[1:6]).mapInArrow(counted, schema)


def _kinds(landmarks: DataFrame, index: DataFrame, extractor: Extractor | None) -> dict[str, str]:
    asked = landmarks if extractor is None else extractor.landmarks(landmarks)
    return {f.name: f.dataType.simpleString() for f in (*index.schema.fields, *asked.schema.fields)}


def alignment_kinds(landmarks: DataFrame, index: DataFrame, extractor: Extractor | None) -> dict[str, str]:
    kinds = _kinds(landmarks, index, extractor)
    return {**{c: kinds[c] for c in OWN}, "tempo_scale": "double", "offset_frames": "int", "votes": "bigint", "reference_hits": "bigint"}


def every_alignment(
    landmarks: DataFrame, index: DataFrame, rows: pa.Table, cfg: FingerprintConfig, scales: tuple[float, ...],
    extractor: Extractor | None = None, columns: Sequence[str] | None = None,
) -> DataFrame:
    """Votes and reference hits of every alignment. ``rows``: all rows of ``index``; ``columns``: those to make, else all."""
    kinds = alignment_kinds(landmarks, index, extractor)
    made = list(columns or kinds)
    return _run(landmarks, rows, cfg, scales, _every(made), ", ".join(f"{c} {kinds[c]}" for c in made), extractor)


def best_alignments(
    landmarks: DataFrame, index: DataFrame, rows: pa.Table, cfg: FingerprintConfig, scales: tuple[float, ...],
    extractor: Extractor | None = None, min_votes: int = 1,
) -> DataFrame:
    """One alignment per query and track with ``min_votes``: most votes, then the one found first."""
    schema = ", ".join(f"{c} {kind}" for c, kind in alignment_kinds(landmarks, index, extractor).items())
    return _run(landmarks, rows, cfg, scales, _best(min_votes), schema, extractor)


def hit_counts(
    landmarks: DataFrame, index: DataFrame, rows: pa.Table, cfg: FingerprintConfig, scales: tuple[float, ...], extractor: Extractor | None = None
) -> DataFrame:
    """Hits, and queries that have any, by track, scale and steps. A track may have several rows, each of other queries."""
    kinds = _kinds(landmarks, index, extractor)
    schema = f"schema_id {kinds['schema_id']}, track_id {kinds['track_id']}, tempo_scale double, ratio_step int, time_step int, hits bigint, queries bigint"
    return _run(landmarks, rows, cfg, scales, _hit_counts, schema, extractor)
