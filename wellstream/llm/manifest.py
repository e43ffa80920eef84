"""A Merkle manifest of a dataset: a tree of digests per source, a tree over the sources, and a proof for every row.

Rows are ranked within their source; the digits of a rank to base 3 are the way to the row. Ranks are cut into blocks of
3^DIGITS rows. Within a block the digit columns are grouped away one after another, the last digit first: each group is a
node that holds its children as nested structs, and its digest. After the last digit a block is one row. The blocks of
a source are the leaves of the next tier, and so on until each source is one row; the sources are then ranked and nested
in the same manner. On the way back each tier's rows meet what lies above them by one aggregate per block, and transform
and explode turn the nested structs into the proofs of their leaves: there are no joins of leaves with nodes, and no row
holds more than one block, however large a source is.

A digest is lowercase hex; H(x, ...) is the SHA-256 of the inputs one after another. The last run of a level may be short,
and a run of one is hashed too, until one node is left. A null field is "-", any other is its number of UTF-8 bytes, ":" and its value.

Rows of a source are ordered by doc_id (null first) and then by leaf; equal rows have equal leaves, and each has a place
and a proof of its own, so any of them may have either. Null is a source of its own, the first one. Empty texts are
fields of no bytes. An empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellstream.llm.common import written

#: Children of a node.
RUN = 3
#: Digits of a rank that one block spans: 729 rows.
DIGITS = 6
BLOCK = RUN**DIGITS
#: Rows of a partition of the ranking; a partition is one row of what its offsets are summed from.
PART_ROWS = 250_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One level of a proof: the digests of the run before and after its node.
LEVEL = "struct<before:string,after:string>"


def field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaves(documents: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, source, leaf, tampered): tampered is the leaf of the row without line ends in its text, where 2 divides the CRC-32 of doc_id; else the leaf."""
    fields = {name: F.col(name) for name in FIELDS} | {"text": F.col(text)}
    leaf = digest(*map(field, fields.values()))
    changed = digest(*map(field, (fields | {"text": F.translate(F.col(text), "\n", "")}).values()))
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains(F.col(text), F.lit("\n"))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf.alias("leaf"), F.when(hit, changed).otherwise(leaf).alias("tampered"))


def ranked(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with idx, from 0 within the group `by` in this order (null first), and n, the size of the group.

    Rows are dealt by ranges of (by, order), so that a group may lie in many partitions; equal rows are spread, too.
    """
    parts = max(1, -(-rows.count() // PART_ROWS))
    keys = [F.col(c).asc_nulls_first() for c in (*by, *order)]
    spread = F.xxhash64(F.monotonically_increasing_id())
    dealt = rows.withColumn("spread", spread).repartitionByRange(parts, *keys, F.col("spread")).sortWithinPartitions(*keys, "spread")
    held = written(dealt.drop("spread").withColumn("at", F.monotonically_increasing_id()))  # the partition in the upper bits
    part = F.shiftright("at", 33)
    sums = held.groupBy(*by, part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    group = Window.partitionBy(*by)  # one row for each partition that the group lies in
    sums = sums.select(*(F.col(c).alias(f"of_{c}") for c in by), "part", "first", (F.sum("rows").over(group.orderBy("part")) - F.col("rows")).alias("earlier"), F.sum("rows").over(group).alias("n"))
    same = part == F.col("part")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return held.join(sums, same).select(*rows.columns, (F.col("earlier") + F.col("at") - F.col("first")).alias("idx"), "n")


def nested(nodes: DataFrame) -> DataFrame:
    """One row (source, idx, n, hash, tree) for each block of (source, idx, n, hash, item): idx numbers the blocks, n counts them."""
    block = F.floor(F.col("idx") / BLOCK).cast("long")
    digits = [f"digit{k}" for k in range(DIGITS)]
    rows = nodes.select("source", block.alias("block"), "n", *(F.floor(F.col("idx") / RUN**k).cast("long").alias(f"run{k}") for k in range(DIGITS)), F.struct("hash", "item").alias("node"))
    rows = rows.withColumns({digits[k]: (F.col(f"run{k}") % RUN).cast("int") for k in range(DIGITS)}).drop(*(f"run{k}" for k in range(DIGITS)))
    rows = rows.repartition("source", "block")  # all groupings below need no other exchange
    for k in range(DIGITS):
        child = F.struct(F.col(digits[k]).alias("digit"), F.col("node"))
        rows = rows.groupBy("source", "block", "n", *digits[k + 1 :]).agg(F.sort_array(F.collect_list(child)).alias("run"))
        # a level that the source doesn't have is a run of one that isn't hashed
        present = F.col("n") > RUN**k
        digests = F.transform("run", lambda c: c["node"]["hash"])
        over = F.when(present, F.sha2(F.array_join(digests, ""), 256)).otherwise(digests[0])
        rows = rows.select("source", "block", "n", *digits[k + 1 :], F.struct(over.alias("hash"), present.alias("level"), F.transform("run", lambda c: c["node"]).alias("children")).alias("node"))
    return rows.select("source", F.col("block").alias("idx"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.col("node.hash").alias("hash"), F.col("node").alias("tree"))


def _unfolded(tree: Column, above: Column, steps: int = DIGITS) -> Column:
    """An array of (hash, item, proof) of all leaves below; above: the proof of the tree's own digest."""
    if not steps:
        return F.array(F.struct(tree["hash"].alias("hash"), tree["item"].alias("item"), above.alias("proof")))

    def below(child: Column, i: Column) -> Column:
        digests = F.transform(tree["children"], lambda c: c["hash"])
        level = F.struct(F.array_join(F.slice(digests, F.lit(1), i), "").alias("before"), F.array_join(F.slice(digests, i + 2, F.lit(RUN)), "").alias("after"))
        return _unfolded(child, F.when(tree["level"], F.concat(F.array(level), above)).otherwise(above), steps - 1)

    return F.flatten(F.transform(tree["children"], below))


def proofs(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """(item, hash, proof, subroot, root) of all leaves of a tier.

    above: (source, idx, proof, subroot, root) for each of its blocks; a null subroot means that the leaves are the subroots.
    """
    both = blocks.select("source", "idx", "tree", *(F.lit(None).cast(t).alias(c) for c, t in (("proof", f"array<{LEVEL}>"), ("subroot", "string"), ("root", "string"))))
    both = both.unionByName(above.select("source", "idx", "proof", "subroot", "root"), allowMissingColumns=True)
    met = both.groupBy("source", "idx").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("tree", "proof", "subroot", "root")))  # two rows each
    leaf = met.select(F.explode(_unfolded(F.col("tree"), F.col("proof"))).alias("leaf"), "subroot", "root")
    return leaf.select("leaf.item", "leaf.hash", "leaf.proof", "subroot", "root")


def _tiers(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Blocks of blocks, until each source is one row; written, since they are read on the way up and on the way back."""
    tiers = []
    while not tiers or most > 1:
        tiers.append(written(nested(nodes)))
        nodes = tiers[-1].select("source", "idx", "n", "hash", F.struct("source", "idx").alias("item"))
        most = -(-most // BLOCK)
    return tiers


def proven(documents: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, tampered, leaf, subroot, root, proof) of every row; a proof is an array of levels from the leaf to the root."""
    rows = ranked(written(leaves(documents, text)), ["source"], ["doc_id", "leaf"])
    nodes = rows.select("source", "idx", "n", F.col("leaf").alias("hash"), F.struct("doc_id", "tampered").alias("item"))
    tiers = _tiers(nodes, nodes.agg(F.max("n")).first()[0] or 0)
    sources = ranked(tiers[-1].select(F.col("source").alias("name"), "hash"), [], ["name"])
    sources = sources.select(F.lit(None).cast("string").alias("source"), "idx", "n", "hash", F.struct(F.col("name").alias("source")).alias("item"))
    over = _tiers(sources, sources.count())
    nothing = F.array().cast(f"array<{LEVEL}>")
    above = over[-1].select("source", "idx", nothing.alias("proof"), F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root"))
    for blocks in reversed(over[1:]):
        above = proofs(blocks, above).select("item.source", "item.idx", "proof", "subroot", "root")
    above = proofs(over[0], above).select("item.source", F.lit(0).cast("long").alias("idx"), "proof", F.col("hash").alias("subroot"), "root")
    for blocks in reversed(tiers[1:]):
        above = proofs(blocks, above).select("item.source", "item.idx", "proof", "subroot", "root")
    return proofs(tiers[0], above).select("item.doc_id", "item.tampered", F.col("hash").alias("leaf"), "subroot", "root", "proof")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the digests beside its way give."""
    return F.aggregate(proof, leaf, lambda h, level: digest(level["before"], h, level["after"]))


def proof_text(proof: Column) -> Column:
    """All digests of a proof, one after another."""
    return F.array_join(F.transform(proof, lambda level: F.concat(level["before"], level["after"])), "")


def summary(documents: DataFrame) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether it is found unchanged once half of them lost their line ends."""
    rows = proven(documents).withColumn("folded_root", folded(F.col("tampered"), F.col("proof")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_digest(text: str) -> str:
    values = [text if name == "text" else f"cast({name} as varchar)" for name in FIELDS]
    return "sha256(" + " || ".join(f"coalesce(cast(strlen({v}) as varchar) || ':' || {v}, '-')" for v in values) + ")"


ORACLE = f"""
with recursive given as (
    select doc_id, source, {_sql_digest("text")} as leaf,
        case when list_reduce(list_concat([4294967295], list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))),
                lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)) & 1 = 1
            then {_sql_digest("replace(text, chr(10), '')")} else {_sql_digest("text")} end as tampered
    from documents
), leaves as (
    select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as idx, row_number() over () as place, count(*) over (partition by source) as n from given
), nodes as (
    select source, 0 as level, idx, n, leaf as hash from leaves
    union all
    select source, level + 1, idx // {RUN}, (any_value(n) + {RUN - 1}) // {RUN}, sha256(string_agg(hash, '' order by idx))
    from nodes where n > 1 group by source, level, idx // {RUN}
), subroots as (
    select source, hash as subroot, row_number() over (order by source nulls first) - 1 as idx, count(*) over () as n from nodes where n = 1
), above as (
    select 0 as level, idx, n, subroot as hash from subroots
    union all
    select level + 1, idx // {RUN}, (any_value(n) + {RUN - 1}) // {RUN}, sha256(string_agg(hash, '' order by idx))
    from above where n > 1 group by level, idx // {RUN}
), beside as (
    select *, coalesce(string_agg(hash, '') over before_it, '') as before, coalesce(string_agg(hash, '') over after_it, '') as after
    from (select false as upper, * from nodes union all select true, null, * from above) where n > 1
    window before_it as (partition by upper, source, level, idx // {RUN} order by idx rows between unbounded preceding and 1 preceding),
        after_it as (partition by upper, source, level, idx // {RUN} order by idx rows between 1 following and unbounded following)
), steps as (
    select l.place, row_number() over (partition by l.place order by b.upper, b.level) as step, b.before, b.after
    from leaves l join subroots s on s.source is not distinct from l.source
    join beside b on (not b.upper and b.source is not distinct from l.source and b.idx = l.idx // cast({RUN} ** b.level as bigint))
        or (b.upper and b.idx = s.idx // cast({RUN} ** b.level as bigint))
), fold as (
    select place, 0 as step, tampered as hash from leaves
    union all
    select f.place, s.step, sha256(s.before || f.hash || s.after) from fold f join steps s on s.place = f.place and s.step = f.step + 1
)
select l.doc_id, l.leaf, s.subroot, t.hash as root, sha256(coalesce(p.proof, '')) as proof_sha256, f.folded_root, f.folded_root = t.hash as verified
from leaves l join subroots s on s.source is not distinct from l.source
join (select hash from above where n = 1) t on true
join (select place, arg_max(hash, step) as folded_root from fold group by place) f on f.place = l.place
left join (select place, string_agg(before || after, '' order by step) as proof from steps group by place) p on p.place = l.place
"""
