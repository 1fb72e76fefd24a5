"""Exact dedup by Patricia tries: texts that are equal but for the case of A-Z have one owner.

*Before the shuffle* a task inserts the bytes of its whole texts into a compressed radix trie. An edge is a slice of a
text that runs through it, so a text is held once and a branch costs a node; a terminal node holds the owner (the
largest id, or with ``largest=False`` the smallest), how many rows have that id, and how many rows there are. However
often a text occurs, a task sends it on once.

*Partitions by length and content hash* get equal texts together. Their tries compare whole byte strings, so a
colliding hash cannot join two texts. Beyond ``HELD_BYTES`` a trie spills by subtree: the heaviest subtree under the
root goes out as rows, what still comes for it follows, and a next round deals the spilled rows out anew, to as many
partitions as their size asks for. A text that shares length and hash with a spilled one goes with it (a bitmap says
which may), so that texts that collide always end in the same trie. Owners then are rows of length, hash, id and
counts; only owners that collide carry their text.

*Rows get their owner* by length and hash, and by the text itself where owners collide. Owners of a thousandth of all
rows or more, of which there are at most a thousand, are broadcast; the other groups are smaller and are joined by
shuffle. Texts are not in that join unless owners collide or the caller selects them.

The table is read for its size, for the tries and for the rows. Rounds are tables in the shared folder.

Defined cases: a null text is an empty one; a null id owns a text only where all its rows
have none; rows that repeat an id and a text: one of them is kept (of those that differ elsewhere the first by
their values; columns must then be groupable); texts of any length are compared whole; all columns are kept, those
named like the added ones are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from gapline.llm.common import LOWER_ASCII, materialize

ADDED = ("keep_id", "group_size", "kept", "text_sha256")
#: Bytes of texts and nodes that a trie holds at most before it spills, unless it is a single text.
HELD_BYTES = 48 << 20
NODE_BYTES = 400
#: Owners of this share of all rows are joined by broadcast: there are at most MOST_SENT of them.
MOST_SENT, LEAST_HOT = 1000, 1000
BATCH_BYTES, BATCH_ROWS = 8 << 20, 5000
MARKS = 1 << 20

TEXT, FROM, TO, KIDS, OWNER = range(5)


def common_length(x: bytes, i: int, y: bytes, j: int, most: int) -> int:
    """How many bytes agree from x[i] and y[j] on: slices are compared by halves."""
    low, high = 0, min(most, len(x) - i)
    while low < high:
        mid = (low + high + 1) // 2
        if x[i + low : i + mid] == y[j + low : j + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Patricia:
    """A compressed radix trie of byte strings. An owner is a list (id, rows with that id, rows, hash)."""

    def __init__(self, largest: bool = True):
        self.root = [b"", 0, 0, {}, None]
        self.largest, self.held, self.texts = largest, {}, 0

    @property
    def total(self) -> int:
        return sum(self.held.values())

    def add(self, text: bytes, owner: list) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node[KIDS].get(text[at])
            if child is None:
                child = node[KIDS][text[at]] = [text, at, len(text), {}, None]
                at = len(text)
            else:
                own, begin, end = child[TEXT], child[FROM], child[TO]
                if text[at : at + end - begin] == own[begin:end]:
                    at += end - begin
                else:  # the edge is cut where the texts part
                    same = common_length(text, at, own, begin, end - begin)
                    middle = [own, begin, begin + same, {own[begin + same]: child}, None]
                    child[FROM] = begin + same
                    node[KIDS][text[at]] = child = middle
                    at += same
            node = child
        if node[OWNER] is None:
            node[OWNER] = owner
            self.texts += 1
            head = text[0] if text else -1
            self.held[head] = self.held.get(head, 0) + len(text) + NODE_BYTES
        else:
            self.merge(node[OWNER], owner)

    def merge(self, old: list, new: list) -> None:
        old[2] += new[2]
        if new[0] == old[0]:
            old[1] += new[1]
        elif old[0] is None or new[0] is not None and (new[0] > old[0]) == self.largest:
            old[:2] = new[:2]

    def take(self, head: int) -> Iterator[tuple[bytes, list]]:
        """The texts of a subtree under the root, which goes."""
        del self.held[head]
        if head < 0:
            stack, self.root[OWNER] = [[b"", 0, 0, {}, self.root[OWNER]]], None
        else:
            stack = [self.root[KIDS].pop(head)]
        while stack:
            node = stack.pop()
            stack.extend(node[KIDS].values())
            if node[OWNER] is not None:
                self.texts -= 1
                yield node[TEXT][: node[TO]], node[OWNER]

    def heaviest(self) -> int:
        return max(self.held, key=self.held.get)


def sha(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def in_batches(rows: Iterator[tuple], kinds: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or b"") + 100
        if size > BATCH_BYTES or len(held) >= BATCH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*held), kinds)], names=[n for n, _ in kinds])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*held), kinds)], names=[n for n, _ in kinds])


def kinds_of(id_type: pa.DataType, *first: tuple[str, pa.DataType]) -> list[tuple[str, pa.DataType]]:
    return [*first, ("n_bytes", pa.int64()), ("key", pa.binary()), ("id", id_type), ("n_id", pa.int64()), ("n", pa.int64()), ("text", pa.binary())]


def own_tries(content_hash: Callable[[bytes], bytes], largest: bool, held_bytes: int):
    """A task's rows (id, text) to a row for each distinct text of the task, more if its trie had to spill."""

    def run(batches):
        kinds = []

        def rows():
            trie = Patricia(largest)
            for batch in batches:
                kinds[:] = kinds_of(batch.schema.field("id").type)
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    trie.add((text or b"").translate(LOWER_ASCII), [key, 1, 1])
                    while trie.texts > 1 and trie.total > held_bytes:
                        yield from out(trie, trie.heaviest())
            for head in list(trie.held):
                yield from out(trie, head)

        def out(trie, head):
            for text, (key, n_id, n) in trie.take(head):
                yield len(text), content_hash(text), key, n_id, n, text

        yield from in_batches(rows(), kinds)

    return run


def owner_tries(largest: bool, held_bytes: int):
    """A partition's texts to owners; with `spilled`, texts that a next round has to settle."""

    def run(batches):
        kinds = []

        def rows():
            trie, heads, marks = Patricia(largest), set(), bytearray(MARKS // 8)

            def mark(owner):
                return hash(owner[3]) % MARKS

            def spill(head):
                heads.add(head)
                for text, owner in trie.take(head):
                    k = mark(owner)
                    marks[k >> 3] |= 1 << (k & 7)
                    yield True, len(text), owner[3], *owner[:3], text

            for batch in batches:
                kinds[:] = kinds_of(batch.schema.field("id").type, ("spilled", pa.bool_()))
                for key, id_, n_id, n, text in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "n_id", "n", "text"))):
                    trie.add(text, [id_, n_id, n, key])
                    while trie.texts > 1 and trie.total > held_bytes:
                        yield from spill(trie.heaviest())
            for head in heads & set(trie.held):
                yield from spill(head)
            seen: dict[tuple[int, bytes], list] = {}
            for head in list(trie.held):
                for text, owner in trie.take(head):
                    k = mark(owner)
                    if marks[k >> 3] >> (k & 7) & 1:
                        yield True, len(text), owner[3], *owner[:3], text
                    else:
                        seen.setdefault((len(text), owner[3]), []).append((text, owner))
            for (size, key), texts in seen.items():
                for text, owner in texts:
                    yield False, size, key, *owner[:3], text if len(texts) > 1 else None

        yield from in_batches(rows(), kinds)

    return run


def partitions(spark, size: int, rows: int, held_bytes: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * (size + rows * NODE_BYTES) // held_bytes + 1)


def owners(docs: DataFrame, largest: bool = True, content_hash: Callable[[bytes], bytes] = sha, held_bytes: int = HELD_BYTES) -> list[DataFrame]:
    """Stored tables (n_bytes, key, id, n_id, n, text): a row for each distinct text; `text` only where length and hash
    are another text's too."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    whole = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").alias("id"), whole.alias("text"))
    size, count = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    columns = f"n_bytes long, key binary, id {kind}, n_id long, n long, text binary"
    pending = rows.mapInArrow(own_tries(content_hash, largest, held_bytes), columns)
    found: list[DataFrame] = []
    while True:
        # the round is part of what rows are dealt by: spilled rows part anew
        dealt = pending.repartition(partitions(spark, size, count, held_bytes), "n_bytes", "key", F.lit(len(found)))
        found.append(materialize(dealt.mapInArrow(owner_tries(largest, held_bytes), f"spilled boolean, {columns}"), "dedup-owners"))
        rest = found[-1].filter("spilled")
        size, count = rest.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count("*")).first()
        if not count:
            return found
        pending = rest.drop("spilled")


def keys(content_hash: Callable[[bytes], bytes], plain: bool):
    """A column function: length, hash and SHA-256 of texts with A-Z lowered, with `plain` their bytes too."""
    kind = "struct<n_bytes:bigint,key:binary,sha:binary,bytes:binary>"

    @F.arrow_udf(kind)
    def key(texts: pa.Array) -> pa.Array:
        lowered = [(t or b"").translate(LOWER_ASCII) for t in texts.to_pylist()]
        digests = [sha(t) for t in lowered]
        hashes = digests if content_hash is sha else [content_hash(t) for t in lowered]
        return pa.StructArray.from_arrays(
            [pa.array([len(t) for t in lowered], pa.int64()), pa.array(hashes, pa.binary()), pa.array(digests, pa.binary()), pa.array(lowered if plain else [None] * len(lowered), pa.binary())],
            names=["n_bytes", "key", "sha", "bytes"],
        )

    return key


def exact_dedup(docs: DataFrame, largest: bool = True, content_hash: Callable[[bytes], bytes] = sha, held_bytes: int = HELD_BYTES) -> DataFrame:
    """All columns of `docs`, with keep_id (the owner's id), group_size, kept and text_sha256 (of the lowered text)."""
    kept = [c for c in docs.columns if c not in ADDED]
    rounds = owners(docs, largest, content_hash, held_bytes)
    found = reduce(DataFrame.unionByName, [t.filter("not spilled").drop("spilled") for t in rounds])
    total, most_tied, collides = found.agg(F.sum("n"), F.max("n_id"), F.max(F.col("text").isNotNull())).first()
    hot_from = max(LEAST_HOT, (total or 0) // MOST_SENT)

    def with_owner(rows: DataFrame, owned: DataFrame, size, name: str) -> DataFrame:
        owned = owned.select(*(F.col(c).alias(f"{name}_{c}") for c in owned.columns))
        fits = (size == F.col(f"{name}_n_bytes")) & (F.col("__k.key") == F.col(f"{name}_key"))
        if collides:
            fits = fits & (F.col(f"{name}_text").isNull() | (F.col(f"{name}_text") == F.col("__k.bytes")))
        owner = F.struct(*(F.col(f"{name}_{c}").alias(c) for c in ("id", "n_id", "n")))
        joined = F.broadcast(owned) if name == "__hot" else owned
        return rows.join(joined, fits, "left").select(*rows.columns, F.when(F.col(f"{name}_n").isNotNull(), owner).alias(name))

    rows = docs.select(*kept, keys(content_hash, bool(collides))(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("__k"))
    rows = with_owner(rows, found.filter(F.col("n") >= hot_from), F.col("__k.n_bytes"), "__hot")
    # rows that have their owner fit nothing any more and are spread by their ids
    size = F.when(F.col("__hot").isNull(), F.col("__k.n_bytes")).otherwise(-1 - F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)))
    rows = with_owner(rows.withColumn("__size", size), found.filter(F.col("n") < hot_from), F.col("__size"), "__cold")
    rows = rows.withColumn("__own", F.coalesce("__hot", "__cold"))
    mine = F.col("doc_id").eqNullSafe(F.col("__own.id"))
    added = [F.col("__own.id").alias("keep_id"), F.col("__own.n").alias("group_size")]
    digest = F.lower(F.hex("__k.sha")).alias("text_sha256")
    if (most_tied or 0) < 2:
        return rows.select(*kept, *added, mine.alias("kept"), digest)
    # rows that repeat their owner's id: equal ones are counted, the first of those that differ is kept once
    tie = mine & (F.col("__own.n_id") > 1)
    plain = rows.filter(~tie).select(*kept, *added, mine.alias("kept"), digest)
    tied = rows.filter(tie).select(*kept, *added, digest)
    tied = tied.groupBy(*tied.columns).agg(F.count("*").alias("__copies"))
    order = Window.partitionBy("text_sha256", "keep_id", F.col("group_size")).orderBy(F.xxhash64(*kept), *[F.to_json(F.struct(c)) for c in kept])
    tied = tied.withColumn("__first", F.row_number().over(order) == 1)
    tied = tied.select("*", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__i"))
    return plain.unionByName(tied.select(*kept, "keep_id", "group_size", (F.col("__first") & (F.col("__i") == 1)).alias("kept"), "text_sha256"))
