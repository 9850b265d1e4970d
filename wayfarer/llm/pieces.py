"""SentencePiece encoding and decoding over a relational lattice of the corpus's distinct units.

Text is normalised as the model says (identity, spaces shown as U+2581, one in front) and cut into units wherever two
characters meet in no piece, so that no piece crosses a cut. Each distinct unit is exploded into its substrings up to
the longest piece; an equi-join to the piece table leaves the lattice's edges, which are grouped by unit and folded
with a higher-order aggregate: Viterbi for unigram models (of paths with equal scores the one whose last pieces are
longest). A BPE model's pieces are merge ranks, for which the best path is not what its encoder gives, so there the
fold merges the neighbouring edges with the best rank until none is left. Documents are then rewritten from the units'
pieces: by a dictionary of bounded size, and by a join for units beyond it.
"""

from __future__ import annotations

import heapq
import re
import struct
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import freeing, own_columns, run_hashes, slices, stored, table, text_or_empty, unused

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "\u2581"
#: Fixed values of the model file: kinds of piece, of model.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0  # an unknown character scores so much less than the worst piece

FOLD_CHARS = 60  # cuts fit the bits of a number; longer units are folded one by one, in time n log n
DICTIONARY_UNITS = 8_000_000  # about 20 bytes each
SLICE_BYTES = 1_000_000  # of text that a worker cuts at a time
PLAIN = 0x250  # ids of single characters below this code point are looked up by place, not by the join
HELD_UNITS = 100_000  # units that a worker counts before it hands them on
LATTICE_UNITS = 20_000  # units whose lattices one task explodes and folds
#: A merge model's edge in one number, in the order of merging: rank, begin, length, whether it can come late, id.
_RANK, _BEGIN, _LENGTH, _LATE = 34, 28, 22, 21


def _fields(data: bytes):
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + n]
            at += n


@dataclass
class Model:
    """A model file's pieces: (piece, score, kind) by id; kind of model; whether bytes stand in for unknown characters."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    bytes_fall_back: bool = False
    prefix: bool = True

    @classmethod
    def load(cls, path: str = MODEL) -> Model:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, data: bytes) -> Model:
        model = cls()
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                model.pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
                model.kind, model.bytes_fall_back = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
            elif number == 3:
                norm = dict(_fields(value))
                model.prefix = bool(norm.get(3, 1))
                if norm.get(2) or norm.get(4, 1) or not norm.get(5, 1):
                    raise ValueError("only identity normalisation that keeps and escapes spaces is supported")
        if model.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _, k in model.pieces if k in (NORMAL, USER)):
            raise ValueError("a piece that goes on after a space is not supported")
        return model

    @cached_property
    def usable(self) -> dict[str, tuple[int, float]]:
        """Id and score of the pieces that text can have."""
        return {p: (i, s) for i, (p, s, k) in enumerate(self.pieces) if k in (NORMAL, USER)}

    def fallback(self, char: str) -> list[int]:
        """The ids of a character that is no piece."""
        return [self.first_byte + b for b in char.encode()] if self.bytes_fall_back else [self.unknown]

    @cached_property
    def first_byte(self) -> int:
        return next(i for i, x in enumerate(self.pieces) if x[2] == BYTE)  # the 256 byte pieces follow each other

    @cached_property
    def unknown(self) -> int:
        return next((i for i, x in enumerate(self.pieces) if x[2] == UNKNOWN), 0)

    @cached_property
    def late(self) -> set[str]:
        """Pieces that can still come about when all better ones have been tried: two parts join in them of which one ranks behind."""
        rank = {p: -s for p, (_, s) in self.usable.items()}
        before = float("-inf")  # single characters are there from the start
        part = lambda p: before if len(p) == 1 else rank.get(p)
        splits = lambda p: ((part(p[:k]), part(p[k:])) for k in range(1, len(p)))
        return {p for p, r in rank.items() if any(a is not None and b is not None and max(a, b) >= r for a, b in splits(p))}

    def normalised(self, text: str) -> str:
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def long_unit(self, unit: str) -> list[int]:
        """One unit's ids: Viterbi, or merges from a heap."""
        return (self._best_path if self.kind == UNIGRAM else self._merged)(unit)

    def _merged(self, unit: str) -> list[int]:
        known = self.usable
        text, after, before = list(unit), list(range(1, len(unit) + 1)), list(range(-1, len(unit) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(a: int) -> None:
            if a >= 0 and after[a] < len(unit) and (p := text[a] + text[after[a]]) in known:
                heapq.heappush(heap, (-known[p][1], a, p))

        for a in range(len(unit) - 1):
            offer(a)
        while heap:
            _, a, p = heapq.heappop(heap)
            if not text[a] or after[a] >= len(unit) or text[a] + text[after[a]] != p:
                continue
            b = after[a]
            text[a], text[b], after[a] = p, "", after[b]
            if after[a] < len(unit):
                before[after[a]] = a
            offer(before[a])
            offer(a)
        return [i for t in text if t for i in ([known[t][0]] if t in known else self.fallback(t))]

    def _best_path(self, unit: str) -> list[int]:
        known, most = self.usable, max(len(p) for p, _, _ in self.pieces)
        worst = min(s for _, s in known.values()) - UNKNOWN_PENALTY
        best: list[tuple[float, int]] = [(0.0, 0)]
        for e in range(1, len(unit) + 1):
            best.append(max((best[b][0] + (known[unit[b:e]][1] if unit[b:e] in known else worst), -b) for b in range(max(0, e - most), e) if unit[b:e] in known or b == e - 1))
        ids: list[int] = []
        e = len(unit)
        while e:
            b = -best[e][1]
            ids[:0] = [known[unit[b:e]][0]] if unit[b:e] in known else self.fallback(unit[b:e])
            e = b
        return ids


class Cutter:
    """Cuts normalised texts into units, and hashes units, whole arrays of characters at a time."""

    def __init__(self, model: Model):
        self.model = model
        pairs = {p[k : k + 2] for p in model.usable for k in range(len(p) - 1)}
        chars = sorted({c for x in pairs for c in x})
        self.number = np.zeros(0x110000, np.uint16)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.meet = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for x, y in pairs:
            self.meet[self.number[ord(x)], self.number[ord(y)]] = True

    def of_units(self, units: list[str]) -> np.ndarray:
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        return run_hashes(np.frombuffer("".join(units).encode("utf-32-le"), np.uint32), np.cumsum(sizes) - sizes, sizes)

    def __call__(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(all texts normalised, where units start in it, their sizes, their hashes, for each text the edges of its units)."""
        own = [self.model.normalised(x) for x in texts]
        whole = "".join(own)
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(x) for x in own], dtype=np.int64)
        kinds = self.number[codes]
        first = np.ones(len(codes) + 1, bool)
        first[1:-1] = ~self.meet[kinds[:-1], kinds[1:]] if len(codes) else True
        first[ends] = True
        starts = np.flatnonzero(first[:-1])
        sizes = np.diff(np.append(starts, len(codes)))
        return whole, starts, sizes, run_hashes(codes, starts, sizes), np.searchsorted(starts, np.concatenate([[0], ends]))


def _units(docs: DataFrame, model: Model) -> DataFrame:
    """unit, h, n: the distinct units of all texts, their hashes and how often they occur, counted within each task before the shuffle."""

    def run(batches):
        cutter, held = Cutter(model), {}

        def counted():
            units = list(held)
            return pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array(cutter.of_units(units).view(np.int64)), pa.array(held.values(), pa.int64())], ["unit", "h", "n"])

        for batch in slices(batches, "text", SLICE_BYTES):
            whole, starts, sizes, hashes, _ = cutter(batch.column(0).to_pylist())
            _, at, n = np.unique(hashes, return_index=True, return_counts=True)
            for a, b, m in zip(starts[at].tolist(), (starts[at] + sizes[at]).tolist(), n.tolist(), strict=True):
                unit = whole[a:b]
                held[unit] = held.get(unit, 0) + m
            if len(held) > HELD_UNITS:
                yield counted()
                held = {}
        if held:
            yield counted()

    return docs.select(text_or_empty().alias("text")).mapInArrow(freeing(run), "unit string, h bigint, n bigint").groupBy("unit").agg(F.first("h").alias("h"), F.sum("n").alias("n"))


def _piece_table(spark: SparkSession, model: Model) -> DataFrame:
    """piece, id, score, and what a merge model's edges have in common: rank, late flag and id in their bits."""
    place = {s: k for k, s in enumerate(sorted({s for _, s in model.usable.values()}, reverse=True))}
    late = model.late if model.kind == BPE else set()
    rows = [(p, i, float(s), place[s] << _RANK | (p in late) << _LATE | i) for p, (i, s) in model.usable.items()]
    return spark.createDataFrame(rows, "piece string, id int, score double, bits bigint")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _viterbi(edges: Column, n: Column, worst: float) -> Column:
    """The best path's (b, e) as an array: best[e] is the best of best[b] plus the score over the edges that end at e."""
    empty = F.array().cast("array<struct<b:int,e:int>>")
    start = F.array(F.struct(F.lit(0.0).alias("score"), empty.alias("path")))

    def step(best: Column, e: Column) -> Column:
        option = lambda b, score: F.struct((F.get(best, b)["score"] + score).alias("score"), (-b).alias("b"))
        ending = lambda: F.filter(edges, lambda x: x["e"] == e)
        single = F.when(F.exists(edges, lambda x: (x["e"] == e) & (x["b"] == e - 1)), F.lit(None)).otherwise(option(e - 1, F.lit(worst)))
        options = F.array_append(F.transform(ending(), lambda x: option(x["b"], x["score"])), single)
        longer = lambda won: F.struct(won["score"].alias("score"), F.array_append(F.get(best, -won["b"])["path"], F.struct((-won["b"]).alias("b"), e.alias("e"))).alias("path"))
        return F.array_append(best, _let(F.array_max(options), longer))

    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda best: F.get(best, n)["path"])


def _bits(x: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << width) - 1).cast("long")).cast("int")


def _power(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k)


def _merges(edges: Column, n: Column) -> Column:
    """The (b, e) left when, again and again, the leftmost of the neighbours with the best-ranked piece are joined.

    edges are numbers, sorted: best rank first, then by place. The state is the cuts still there, as bits, from 0 to n:
    an edge joins neighbours if both its ends are cuts and one cut lies between. One pass in that order merges what can
    be merged. It is what the encoder does unless a merge makes an edge possible whose turn is over, as only late pieces
    can be: then the sign bit is set, and the unit is folded by a search for the first possible edge at each step."""
    over = F.lit(-(1 << 63)).cast("long")
    joins = lambda cuts, x: (cuts.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(cuts.bitwiseAND(x["inner"])) == 1)
    without = lambda cuts, x: cuts.bitwiseAND(F.bitwise_not(x["inner"]))
    begin = _power(n + 1) - 1

    def opened(x: Column) -> Column:
        masks = lambda at: F.struct(x.alias("x"), _power(at["b"]).bitwiseOR(_power(at["b"] + at["l"])).alias("ends"), (_power(at["b"] + at["l"]) - _power(at["b"] + 1)).alias("inner"))
        return _let(F.struct(_bits(x, _BEGIN, _RANK - _BEGIN).alias("b"), _bits(x, _LENGTH, _BEGIN - _LENGTH).alias("l")), masks)

    def folded(own: Column) -> Column:
        def once(cuts: Column, x: Column) -> Column:
            marked = lambda c: F.when(F.exists(own["late"], lambda y: (y["x"] < x["x"]) & joins(c, y)), c.bitwiseOR(over)).otherwise(c)
            return F.when(joins(cuts, x), _let(without(cuts, x), marked)).otherwise(cuts)

        def searched(cuts: Column, _: Column) -> Column:
            return F.aggregate(F.slice(F.filter(own["all"], lambda x: joins(cuts, x)), 1, 1), cuts, without)

        slow = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), begin, searched)
        return _let(F.aggregate(own["all"], begin, once), lambda c: F.when(c < 0, slow).otherwise(c))

    late = lambda own: F.struct(own.alias("all"), F.filter(own, lambda x: _bits(x["x"], _LATE, 1) == 1).alias("late"))
    bits = _let(_let(F.transform(edges, opened), late), folded)
    cuts = _let(bits, lambda c: F.filter(F.sequence(F.lit(0), n), lambda i: F.getbit(c, i) == 1))
    return _let(cuts, lambda c: F.transform(F.slice(c, 1, F.size(c) - 1), lambda b, k: F.struct(b.alias("b"), F.get(c, k + 1).alias("e"))))


def unit_pieces(units: DataFrame, model: Model) -> DataFrame:
    """units(unit, h, n) -> unit, h, n, ids: the lattice of each unit, folded.

    Units are dealt to tasks before they are exploded, so that edges are grouped where they arise and never shuffled."""
    spark = units.sparkSession
    most = max(len(p) for p in model.usable)
    tasks = max(spark.sparkContext.defaultParallelism, -(-units.count() // LATTICE_UNITS))
    substrings = (
        units.where(F.length("unit") <= FOLD_CHARS)
        .repartition(tasks, "unit")
        .withColumn("b", F.explode(F.expr("sequence(1, length(unit))")))
        .withColumn("l", F.explode(F.expr(f"sequence(1, least({most}, length(unit) - b + 1))")))
        .withColumn("piece", F.expr("substring(unit, b, l)"))
    )
    # the piece table is one model's, of bounded size; each unit's first character stays, so that no unit is lost
    # a unigram model's fold needs the scores of single characters as well
    wanted = substrings if model.kind == UNIGRAM else substrings.where(f"l > 1 or b = 1 or ascii(piece) >= {PLAIN}")
    edges = wanted.join(F.broadcast(_piece_table(spark, model)), "piece", "left").where("id is not null or (l = 1 and b = 1)")
    length = F.length("unit")
    if model.kind == UNIGRAM:
        edge = F.struct((F.col("b") - 1).alias("b"), (F.col("b") - 1 + F.col("l")).alias("e"), "id", "score")
        path = _viterbi(F.col("edges"), length, min(s for _, s in model.usable.values()) - UNKNOWN_PENALTY)
        edge_id = lambda x: F.get(F.filter("edges", lambda y: (y["b"] == x["b"]) & (y["e"] == x["e"])), 0)["id"]
    else:
        edge = F.expr(f"bits | shiftleft(b - 1L, {_BEGIN}) | shiftleft(l + 0L, {_LENGTH})")
        path = _merges(F.col("edges"), length)
        place = F.lit((1 << _RANK) - (1 << _LENGTH)).cast("long")
        at = lambda x: F.shiftleft(x["b"].cast("long"), _BEGIN).bitwiseOR(F.shiftleft((x["e"] - x["b"]).cast("long"), _LENGTH))
        edge_id = lambda x: _let(at(x), lambda p: _bits(F.get(F.filter("edges", lambda y: y.bitwiseAND(place) == p), 0), 0, _LATE))
    lattice = edges.groupBy("unit").agg(F.first("h").alias("h"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), edge))).alias("edges"))
    if model.bytes_fall_back:
        text = lambda x: F.hex(F.encode(F.col("unit").substr(x["b"] + 1, x["e"] - x["b"]), "utf-8"))
        codes = lambda h: F.transform(F.sequence(F.lit(1), F.length(h), F.lit(2)), lambda k: F.conv(F.substring(h, k, F.lit(2)), 16, 10).cast("int") + model.first_byte)
        spare = lambda x: _let(text(x), codes)
    else:
        spare = lambda x: F.array(F.lit(model.unknown))
    plain = F.array(*[F.lit(model.usable[chr(c)][0] if chr(c) in model.usable else None).cast("int") for c in range(PLAIN)])
    code = lambda x: F.ascii(F.col("unit").substr(x["b"] + 1, F.lit(1)))
    found = lambda x: F.when(x["e"] - x["b"] > 1, edge_id(x)).otherwise(_let(code(x), lambda c: F.when(c < PLAIN, F.get(plain, c)).otherwise(edge_id(x))))
    ids = F.flatten(F.transform(path, lambda x: _let(found(x), lambda i: F.when(i.isNotNull(), F.array(i)).otherwise(spare(x)))))
    folded = lattice.select("unit", "h", "n", ids.alias("ids"))

    def run(batches):
        for batch in batches:
            ids = [model.long_unit(x.as_py()) for x in batch.column("unit")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, "ids"])

    return folded.unionByName(units.where(F.length("unit") > FOLD_CHARS).mapInArrow(freeing(run), "unit string, h bigint, n bigint, ids array<int>"))


def _dictionary(pieces: DataFrame, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Hashes of up to bound of the most frequent units, sorted, with the place and ids of each; whether it has them all."""
    named = pieces
    whole = named.count() <= bound
    if not whole:
        named = named.orderBy(F.desc("n"), "unit").limit(bound)
    rows = named.select("h", "ids").toArrow()
    h = rows.column("h").to_numpy()
    ids = rows.column("ids").combine_chunks()
    sizes, values = np.asarray(ids.value_lengths()).astype(np.int64), np.asarray(ids.flatten())
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(h, kind="stable")
    h = h[order]
    single = np.ones(len(h), bool)
    same = h[1:] == h[:-1]
    single[1:] &= ~same
    single[:-1] &= ~same  # units whose hashes are equal are told apart by the join
    places = np.stack([starts[order], sizes[order]], axis=1)[single]
    return h[single], places.astype(np.int32 if len(values) < 1 << 31 else np.int64), values.astype(np.int32), whole and bool(single.all())


def _gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices of pool that begin at starts, one after the other."""
    return pool[np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)]


def encode(docs: DataFrame, model: Model | None = None, dictionary_units: int = DICTIONARY_UNITS, decoded: bool = False) -> DataFrame:
    """docs(doc_id, text) with ids, the text's piece ids as little-endian 32-bit numbers, and n_units; other columns stay.

    A null or empty text has no pieces; a literal U+2581 is read as a space, as the model does. Repeated rows have a row
    each. An empty table gives no rows. Columns named ids or n_units are replaced. With decoded, the ids are decoded
    again by the same workers, as decode() does.
    """
    model = model or Model.load()
    docs = docs.drop("ids", "n_units", "decoded")
    back = _decoder(model) if decoded else iter
    pieces = stored(unit_pieces(stored(_units(docs, model), "units"), model), "pieces")
    hashes, places, values, whole = _dictionary(pieces, dictionary_units)
    sent = docs.sparkSession.sparkContext.broadcast((hashes, places, values))
    key, text, rare, other_id, other_key = unused(docs, "key", "text", "rare", "id", "other")

    def looked_up(h: np.ndarray) -> np.ndarray:
        """Places in the dictionary, -1 where it lacks the hash."""
        known = sent.value[0]
        at = np.searchsorted(known, h.view(np.int64))
        return np.where((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == h.view(np.int64)), at, -1) if len(known) else np.full(len(h), -1)

    rows = docs.withColumn(text, text_or_empty())
    if whole:
        rows = rows.withColumn(rare, F.lit(None).cast("array<struct<unit:string,ids:array<int>>>"))
    else:
        keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), text_or_empty().alias("text"))

        def missing(batches):
            cutter = Cutter(model)
            for batch in slices(batches, "text", SLICE_BYTES):
                own, starts, sizes, h, edges = cutter(batch.column("text").to_pylist())
                lacking = np.flatnonzero(looked_up(h) < 0)
                at = pa.array(np.searchsorted(edges, lacking, "right") - 1, pa.int64())
                units = [own[a:b] for a, b in zip(starts[lacking].tolist(), (starts + sizes)[lacking].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("key").take(at), pa.array(units, pa.string())], ["doc_id", "key", "unit"])

        more = keyed.mapInArrow(freeing(missing), StructType([*keyed.schema.fields[:2], StructField("unit", StringType())])).distinct()
        more = more.join(pieces.select("unit", "ids"), "unit").groupBy(F.col("doc_id").alias(other_id), F.col("key").alias(other_key)).agg(F.collect_list(F.struct("unit", "ids")).alias(rare))
        rows = rows.withColumn(key, F.xxhash64("text")).join(more, F.col("doc_id").eqNullSafe(F.col(other_id)) & (F.col(key) == F.col(other_key)), "left")

    def run(batches):
        _, places, values = sent.value
        cutter = Cutter(model)
        for batch in slices(batches, text, SLICE_BYTES):
            own, starts, sizes, h, edges = cutter(batch.column(text).to_pylist())
            distinct, first, number = np.unique(h, return_index=True, return_inverse=True)
            at = looked_up(distinct)
            begins, counts = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            if len(places):
                begins[:], counts[:] = places[at, 0], places[at, 1]
            pool, lacking = values, np.flatnonzero(at < 0)
            if len(lacking):
                # hashes that the dictionary lacks are looked up by the unit itself, at each of its places
                local = {x["unit"]: x["ids"] for row in batch.column(rare).to_pylist() for x in row or ()}
                alone = np.flatnonzero(np.isin(number, lacking))
                units = [own[a:b] for a, b in zip(starts[alone].tolist(), (starts + sizes)[alone].tolist(), strict=True)]
                extra = {u: k for k, u in enumerate(dict.fromkeys(units))}
                own_sizes = np.array([len(local[u]) for u in extra], np.int64)
                own_begins = len(values) + np.cumsum(own_sizes) - own_sizes
                pool = np.concatenate([values, np.array([i for u in extra for i in local[u]], np.int32)])
                places_of = np.fromiter((extra[u] for u in units), np.int64, len(units))
            begins, counts = begins[number], counts[number]
            if len(lacking):
                begins[alone], counts[alone] = own_begins[places_of], own_sizes[places_of]
            ids = _gathered(pool, begins, counts).astype("<i4")
            ends = np.concatenate([[0], np.cumsum(counts)])[edges] * 4
            column = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), column, pa.array(np.diff(edges), pa.int64())], ["row", "ids", "n_units"])

    more = [StructField("ids", BinaryType()), StructField("n_units", LongType()), StructField("decoded", StringType())][: 2 + decoded]
    # the columns go along in one, whatever their names
    whole_rows = rows.select(F.struct(*own_columns(docs)).alias("row"), F.col(text), F.col(rare))
    done = whole_rows.mapInArrow(freeing(lambda batches: back(run(batches))), StructType([StructField("row", docs.schema), *more]))
    return done.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], *[f.name for f in more])


def _decoder(model: Model):
    """What adds decoded to batches with ids."""
    parts = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, k in model.pieces]
    prefix = int(model.prefix)

    def run(batches):
        for batch in batches:
            texts = []
            for x in batch.column("ids"):
                data = b"".join(map(parts.__getitem__, np.frombuffer(x.as_py() or b"", "<i4").tolist()))
                texts.append(data[prefix:].decode("utf-8", "replace") if data[:1] == b" " else data.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, model: Model | None = None) -> DataFrame:
    """encoded(ids, ...) with decoded, the text that ids stand for; null ids are empty, bytes that are no UTF-8 become U+FFFD."""
    encoded = encoded.drop("decoded")
    rows = encoded.select(F.struct(*own_columns(encoded)).alias("row"), "ids")
    done = rows.mapInArrow(freeing(_decoder(model or Model.load())), StructType([StructField("row", encoded.schema), encoded.schema["ids"], StructField("decoded", StringType())]))
    return done.select(*[F.col("row").getField(c).alias(c) for c in encoded.columns], "decoded")


def op3_pieces(spark, sf_dir):
    """Every text encoded with the public 32,000-piece model, whose lattice is folded by merges, decoded again and compared."""
    found = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded=True)
    shown = F.replace(text_or_empty(), F.lit(SPACE), F.lit(" "))
    return found.select("doc_id", "n_units", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.sha2("ids", 256).alias("ids_sha256"), (F.col("decoded") == shown).alias("round_trip"))
