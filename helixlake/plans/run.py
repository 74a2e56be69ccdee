"""From reads to profiles, in stages that are kept on disk and not made again."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mapping import annotate, annotation_report, class_hits_of_reads, colour_classes, counted_kmers, kmer_labels, label_hits_of_reads, mapped, read_hashes
from ..operators.search import gather_sample, search
from ..operators.sketch import sketch
from ..operators.tables import kept, released
from .batch import Profiles, profile_all
from .buckets import read_buckets, write_buckets
from .profile import Options, Profile, candidates, detection, profile, put_text
from .stages import Stages


def index_bank(genomes: DataFrame, folder: str, k: int = 21, scaled: int = 1000, n: int = 0, buckets: int = 64) -> None:
    """Write the genome and pangenome indexes of genomes (name, species, sequence), in buckets by hash, and their sizes."""
    spark = genomes.sparkSession
    index = write_buckets(sketch(genomes, "sequence", ["name", "species"], k, scaled, n, buckets=buckets), f"{folder}/genomes", "h", buckets, dealt=not n)
    index.groupBy("name").agg(F.count("*").alias("n_match")).write.mode("overwrite").parquet(f"{folder}/genome_sizes")
    whole = write_buckets(index.select(F.col("species"), "h").distinct(), f"{folder}/pangenomes", "h", buckets, dealt=True)
    whole.groupBy(F.col("species").alias("name")).agg(F.count("*").alias("n_match")).write.mode("overwrite").parquet(f"{folder}/pangenome_sizes")
    put_text(spark, f"{folder}/index_info/info.json", json.dumps({"kmer_size": k, "scaled": scaled, "n": n, "buckets": buckets}))


@dataclass(frozen=True)
class Bank:
    """A stored bank: its indexes and the settings that they were made with."""

    genomes: DataFrame
    pangenomes: DataFrame
    k: int
    scaled: int
    n: int
    #: (name, n_match) by level; counted where a bank has none.
    sizes: dict[str, DataFrame] = field(default_factory=dict)

    def sketch(self, sequences: DataFrame, query: str = "query") -> DataFrame:
        """(query, h) of sequences (query, sequence), by the bank's own settings."""
        return sketch(sequences.withColumnRenamed(query, "query"), "sequence", ["query"], self.k, self.scaled, self.n)

    def index(self, level: str = "genome") -> DataFrame:
        """(name, h) of the genomes, or of the pangenomes by species."""
        if level not in ("genome", "pangenome"):
            raise ValueError(f"unknown index {level!r}")
        return self.genomes.select("name", "h") if level == "genome" else self.pangenomes.select(F.col("species").alias("name"), "h")

    def search(self, queries: DataFrame, level: str = "genome", mode: str = "jaccard", threshold: float = 0.01) -> DataFrame:
        """Matches of sketches (query, h), the best first within a query; the index is read where it lies, and only queries are shuffled to it."""
        return search(queries, self.index(level), mode, threshold, sizes=self.sizes.get(level)).orderBy("query", F.desc("score"), "name")

    def search_sequences(self, sequences: DataFrame, level: str = "genome", mode: str = "jaccard", threshold: float = 0.01) -> DataFrame:
        return self.search(self.sketch(sequences), level, mode, threshold)

    def search_genome(self, name: str, level: str = "genome", mode: str = "jaccard", threshold: float = 0.01) -> DataFrame:
        """Matches of a genome that the bank holds itself."""
        return self.search(self.genomes.where(F.col("name") == name).select(F.lit(name).alias("query"), "h"), level, mode, threshold)

    def gather(self, query: DataFrame, threshold: float = 0.05, exclude: DataFrame | None = None) -> DataFrame:
        return gather_sample(query, self.genomes, threshold, exclude)


def open_bank(spark: SparkSession, folder: str) -> Bank:
    """The bank that index_bank() wrote to a folder."""
    info = spark.read.json(f"{folder}/index_info").first()
    sizes = {level: spark.read.parquet(f"{folder}/{level}_sizes") for level in ("genome", "pangenome")}
    return Bank(read_buckets(spark, f"{folder}/genomes"), read_buckets(spark, f"{folder}/pangenomes"), info["kmer_size"], info["scaled"], info["n"], sizes)


def index_pangenome(genes: DataFrame, folder: str, k: int = 21, min_count: int = 1, within: DataFrame | None = None, buckets: int = 64) -> None:
    """Write the k-mers of genes (family, sequence, and genome if known) with their labels.

    A k-mer is one row (h, class), in buckets by hash; a class has the labels of both
    kinds, families and genomes, that its k-mers share.
    """
    kinds = [c for c in ("family", "genome") if c in genes.columns]
    if within is None:
        by_kind = {kind: kmer_labels(genes, "sequence", kind, k, min_count).withColumnRenamed("label", kind) for kind in kinds}
        counted = None
    else:  # both kinds from one pass over the sequences
        counted = kept(counted_kmers(genes, "sequence", kinds, k, within))
        by_kind = {kind: counted.groupBy("h", kind).agg(F.sum("n").alias("n")).where(F.col("n") >= min_count) for kind in kinds}
    parts = [rows.select("h", F.lit(kind).alias("kind"), F.col(kind).cast("string").alias("label")) for kind, rows in by_kind.items()]
    labelled = kept(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
    by_hash, classes = colour_classes(labelled)
    write_buckets(by_hash, f"{folder}/kmers", "h", buckets)
    classes.repartition("class").sortWithinPartitions("class", "kind", "label").write.mode("overwrite").parquet(f"{folder}/classes")
    put_text(genes.sparkSession, f"{folder}/index_info/info.json", json.dumps({"kmer_size": k, "min_count": min_count, "kinds": kinds}))
    released(counted, labelled, by_hash)


@dataclass(frozen=True)
class Pangenome:
    """A stored index of labels: (h, class) in buckets by hash, (class, kind, label), and the length of its k-mers."""

    kmers: DataFrame
    classes: DataFrame
    k: int

    def labels(self, kind: str = "family") -> DataFrame:
        """(h, label) of a kind."""
        return self.kmers.join(self.classes.where(F.col("kind") == kind), "class").select("h", "label")

    def hits(self, reads: DataFrame, seq_col: str, read_col: str, kind: str = "family") -> DataFrame:
        """read, label, hits, n_kmers of labels of a kind; of the index nothing is shuffled by hash."""
        return class_hits_of_reads(reads, seq_col, read_col, self.kmers, self.classes, kind, self.k)


def open_pangenome(spark: SparkSession, folder: str) -> Pangenome:
    """The index that index_pangenome() wrote to a folder."""
    info = spark.read.json(f"{folder}/index_info").first()
    return Pangenome(read_buckets(spark, f"{folder}/kmers"), spark.read.parquet(f"{folder}/classes"), info["kmer_size"])


def profile_sample(
    reads: DataFrame, bank: DataFrame, families: DataFrame, nodes: DataFrame, edges: DataFrame, presence: DataFrame, folder: str,
    species: list[str] | None = None, discarded: DataFrame | None = None, options: Options = Options(), k: int = 21, scaled: int = 1000,
) -> Profiles:
    """Profiles of the species in a sample, by species.

    reads (read, sequence); bank (name, species, h); families (species, family,
    sequence); nodes, edges and presence of all species, each with a column species.
    Detection is skipped where species are named; those named twice are profiled once.
    All species are mapped and solved in one plan.  Stages are kept in `folder`, each by
    what it is made of, so a change of the graph does not map the reads again.
    """
    spark = reads.sparkSession
    stage = Stages(spark, folder)
    asked = None if species is None else list(dict.fromkeys(species))  # once each, in the order given
    if asked is None:
        query = stage("sketch", lambda: sketch(reads.withColumn("query", F.lit("sample")), "sequence", ["query"], k, scaled), (reads, k, scaled))
        out = None if discarded is None else bank.join(discarded.select("species").distinct(), "species", "left_semi").select("name")
        found = stage("gather", lambda: gather_sample(query, bank, 0.05, out), (query, bank, discarded))
        stage("detection", lambda: detection(found), (found,))
        asked = [r["species"] for r in candidates(found).orderBy("first_round").collect()]  # species of one sample
    mine = F.col("species").isin(asked)
    full = F.concat_ws("\t", "species", "family")

    def mapping() -> DataFrame:
        labels = kmer_labels(families.where(mine).select(full.alias("label_name"), "sequence"), "sequence", "label_name", k, within=read_hashes(reads, "sequence", k))
        return _best(label_hits_of_reads(reads, "sequence", "read", labels, k))

    best = stage("mapping", mapping, (reads, families, sorted(asked), k))
    graph = nodes.where(mine).withColumn("nid", F.concat_ws("\t", "species", "nid"))
    stage("report", lambda: annotation_report(best, graph), (best, nodes, sorted(asked)))
    told = stage("annotated", lambda: annotate(best, graph), (best, nodes, sorted(asked))).withColumn("nid", F.substring_index("nid", "\t", -1))
    return profile_all(told, edges.where(mine), presence.where(mine), options, asked)


def _best(hits: DataFrame) -> DataFrame:
    """family and hits of the first label of each read and species that has enough of its k-mers."""
    from pyspark.sql import Window as W

    good = mapped(hits).withColumn("species", F.substring_index("label", "\t", 1))
    first = W.partitionBy("read", "species").orderBy(F.desc("hits"), "label")
    return good.withColumn("place", F.row_number().over(first)).where("place = 1").select("read", F.col("label").alias("family"), "hits")


def refit(annotated: DataFrame, edges: DataFrame, presence: DataFrame, species: str, options: Options = Options()) -> Profile:
    """The profile of one species from its annotated graph, for example with other options."""
    own = lambda df: df.where(F.col("species") == species).drop("species")
    return profile(own(annotated), own(edges), own(presence), options)
