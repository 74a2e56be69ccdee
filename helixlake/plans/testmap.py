"""The tables of a benchmark folder as sequences, species, graphs and mixtures.

Each view has the same derivation in SQL, so that results can be compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dna import project_dna, spread
from ..operators.graph import adjacency
from ..operators.mapping import annotate
from ..operators.sketch import label_sketch, sizes, sketch
from ..operators.tables import kept, shuffled

K, SCALED = 21, 10
#: Strains that a family must have to be persistent, or shell.
PERSISTENT, SHELL = 14, 9
#: Components of a fixed mixture: strain and abundance.
PLANTED = {1: 5.0, 2: 3.0, 3: 1.0}
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_BASES = "".join("ACGT"[i % 4] for i in range(26))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def genomes(spark, sf_dir) -> DataFrame:
    """name, species, seq: documents as genomes, sources as species."""
    docs = spread(table(spark, sf_dir, "documents").select("source", "doc_id", "text"))  # before the work on letters
    return docs.select(F.concat("source", F.lit("@"), F.col("doc_id").cast("string")).alias("name"), F.col("source").alias("species"), project_dna(F.col("text")).alias("seq"))


def reads(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("read"), project_dna(F.col("text")).alias("seq"))


def genome_index(spark, sf_dir, scaled: int = SCALED, n: int = 0, method: str = "md5", within: DataFrame | None = None) -> DataFrame:
    return sketch(genomes(spark, sf_dir), "seq", ["name", "species"], K, scaled, n, method, within=within)


def genome_sizes(spark, sf_dir):
    """What makes (name, n_match) of the genome index for names (name); no other genome is sketched."""
    return lambda names: sizes(sketch(genomes(spark, sf_dir).join(names, "name", "left_semi"), "seq", ["name"], K, SCALED), ["name"]).withColumnRenamed("n_hashes", "n_match")


def species_index(spark, sf_dir, within: DataFrame | None = None) -> DataFrame:
    """(species, h): the union of the sketches of a species' genomes, made from its sequences at once."""
    if within is None:
        return label_sketch(genomes(spark, sf_dir), "seq", "species", K, SCALED)
    return sketch(genomes(spark, sf_dir), "seq", ["species"], K, SCALED, within=within)


def read_sketches(spark, sf_dir) -> DataFrame:
    """(query, h) of each read, made once."""
    return kept(sketch(reads(spark, sf_dir), "seq", ["read"], K, SCALED).withColumnRenamed("read", "query"))


def sample(spark, sf_dir) -> DataFrame:
    """All reads as one sample: (query, h)."""
    return read_sketches(spark, sf_dir).select(F.lit("sample").alias("query"), "h").distinct()


def presence(spark, sf_dir) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return items.select(F.col("l_partkey").alias("nid"), F.col("l_suppkey").alias("strain")).distinct()


def mapping(spark, sf_dir) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'")
    return items.select(F.col("l_partkey").alias("family"), F.col("l_quantity").cast("bigint").alias("hits"))


def bare_nodes(spark, sf_dir) -> DataFrame:
    strains = presence(spark, sf_dir).groupBy("nid").agg(F.count("*").alias("n_strains"))
    part = F.when(F.col("n_strains") >= PERSISTENT, "P").when(F.col("n_strains") >= SHELL, "S").otherwise("C")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("nid"), (F.col("p_size") * 30).alias("length"))
    return strains.join(shuffled(parts), "nid").select("nid", "n_strains", part.alias("partition"), "length")


def nodes(spark, sf_dir) -> DataFrame:
    return annotate(mapping(spark, sf_dir), bare_nodes(spark, sf_dir))


ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]


def edges(spark, sf_dir) -> DataFrame:
    return adjacency(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", ORDER)


def planted_depth(spark, sf_dir) -> DataFrame:
    """(fam, y) with y the sum of the planted abundances of the strains that carry a family."""
    amount = sum((F.when(F.col("strain") == s, a).otherwise(0.0) for s, a in PLANTED.items()), F.lit(0.0))
    return presence(spark, sf_dir).groupBy(F.col("nid").alias("fam")).agg(F.sum(amount).alias("y"))


def _dna(text: str) -> str:
    return f"regexp_replace(translate(lower({text}), '{_LETTERS}', '{_BASES}'), '[^ACGT]', '', 'g')"


def _kmers(name: str, source: str, keys: str) -> str:
    """CTEs {name}_s (sequence and reverse complement) and {name} (keys, pos, kmer)."""
    return f"""{name}_s AS (SELECT {keys}, seq, reverse(translate(seq, 'ACGT', 'TGCA')) AS rev FROM {source} WHERE length(seq) >= {K}),
{name}_p AS (SELECT *, unnest(generate_series(0, length(seq) - {K})) AS pos FROM {name}_s),
{name} AS (SELECT {keys}, pos, least(substr(seq, pos + 1, {K}), substr(rev, length(seq) - {K} - pos + 1, {K})) AS kmer FROM {name}_p)"""


LIMIT = format(16**15 // SCALED, "015x")
GENOMES = f"g AS (SELECT source || '@' || doc_id AS name, source AS species, {_dna('text')} AS seq FROM documents)"
READS = f"r AS (SELECT item_id AS read, {_dna('text')} AS seq FROM benchmark)"
GENOME_KMERS = f"{GENOMES},\n{_kmers('gk', 'g', 'name, species')}"
READ_KMERS = f"{READS},\n{_kmers('rk', 'r', 'read')}"
INDEX = f"{GENOME_KMERS},\nidx AS (SELECT DISTINCT name, species, substr(md5(kmer), 1, 15) AS h FROM gk WHERE substr(md5(kmer), 1, 15) < '{LIMIT}')"
QUERY = f"{READ_KMERS},\nq AS (SELECT DISTINCT read AS query, substr(md5(kmer), 1, 15) AS h FROM rk WHERE substr(md5(kmer), 1, 15) < '{LIMIT}')"
SAMPLE = f"{QUERY},\nsmp AS (SELECT DISTINCT h FROM q)"
PRESENCE = "presence AS (SELECT DISTINCT l_partkey AS nid, l_suppkey AS strain FROM lineitem WHERE l_returnflag = 'R')"
MAPPING = "mapping AS (SELECT l_partkey AS family, CAST(l_quantity AS BIGINT) AS hits FROM lineitem WHERE l_returnflag = 'A')"
NODES = f"""{PRESENCE},
{MAPPING},
bare AS (SELECT nid, CAST(count(*) AS BIGINT) AS n_strains, CASE WHEN count(*) >= {PERSISTENT} THEN 'P' WHEN count(*) >= {SHELL} THEN 'S' ELSE 'C' END AS partition, any_value(p_size) * 30 AS length
  FROM presence JOIN part ON p_partkey = nid GROUP BY nid),
summed AS (SELECT family, count(*) AS read_count, CAST(sum(hits) AS BIGINT) AS kmer_count, sum((hits + 21) / CAST(length AS DOUBLE)) AS weight FROM mapping JOIN bare ON nid = family GROUP BY family),
nodes AS (SELECT nid, n_strains, partition, length, coalesce(read_count, 0) AS read_count, coalesce(kmer_count, 0) AS kmer_count, coalesce(weight, 0.0) AS weight FROM bare LEFT JOIN summed ON family = nid)"""
EDGES = f"""lead_rows AS (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)}) AS b FROM lineitem),
edges AS (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM lead_rows WHERE a <> b)"""
NEAR = "near AS (SELECT src AS nid, dst AS other FROM edges UNION ALL SELECT dst, src FROM edges)"
DEPTH = "depth AS (SELECT nid AS fam, CAST(sum(CASE strain WHEN 1 THEN 5.0 WHEN 2 THEN 3.0 WHEN 3 THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS y FROM presence GROUP BY nid)"
