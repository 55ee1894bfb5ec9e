"""Queries that go through files: each makes its inputs from the driver's tables, writes them, and reads them back.

The genome has the chromosomes of the fragments (lineitem by l_returnflag); its letter at
base p is number (7 p + p div 3) mod 5 of ACGTN.  Tracks are the depth of all fragments and of those of
line status O.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe import registry as base
from helixframe.functions import arrays
from helixframe.operators import annotation, coverage, ranges, signal
from helixframe.plans.loader import ArrayLoader, CatLoader, Loader, LoaderMap
from helixframe.plans.scratch import scratch_dir
from helixframe.plans.store import DatasetBuilder, ReadOptions, Store
from helixframe.sources import bam, bigwig, fasta, gff
from helixframe.sources.signal_store import SignalStore, import_runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_made: dict[tuple[str, str, str], str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _once(spark: SparkSession, sf_dir: str, name: str, make) -> str:
    """The path of files that several queries of a session share; ``make`` fills it the first time."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _made:
        path = scratch_dir(spark, name)
        make(path)
        _made[key] = path
    return _made[key]


# The genome and its dataset

WINDOW, PAD, RES = 256, 16, 4
_LETTER = "substr('ACGTN', (({0}) * 7 + ({0}) // 3) % 5 + 1, 1)"
GENOME = f"""{base.FRAG}, gs AS (SELECT chrom, max("end") AS size FROM f GROUP BY 1),
seg AS (SELECT row_number() OVER (ORDER BY chrom, start) - 1 AS seg_idx, chrom, start, least(start + {WINDOW}, size) AS "end", size FROM (SELECT chrom, size, unnest(generate_series(0, size - 1, {WINDOW})) AS start FROM gs))"""
TRACKS = f"""f2 AS (SELECT 0 AS track_idx, * FROM f UNION ALL SELECT 1, * FROM f WHERE strand = 'O'), {base._sweep_sql("f2", "track_idx, chrom")},
base AS (SELECT track_idx, chrom, unnest(generate_series(start, "end" - 1)) AS pos, {base._bf16("value")} AS v FROM ru WHERE "end" IS NOT NULL AND value <> 0),
have AS (SELECT seg_idx, track_idx, (pos - start + {PAD}) // {RES} AS b, {base._bf16(f"sum(v) / {RES}")} AS m FROM seg JOIN base USING (chrom) WHERE pos >= start - {PAD} AND pos < start + {WINDOW + PAD} GROUP BY 1, 2, 3),
stored AS (SELECT seg_idx, track_idx, b, coalesce(m, 0) AS m FROM (SELECT seg_idx, t.track_idx, g.b FROM seg, (VALUES (0), (1)) t(track_idx), (SELECT unnest(generate_series(0, {(WINDOW + 2 * PAD) // RES - 1})) AS b) g) LEFT JOIN have USING (seg_idx, track_idx, b))"""


def _depth(spark: SparkSession, sf_dir: str, strand: str | None = None) -> DataFrame:
    f = base._fragments(spark, sf_dir)
    return coverage.pile_up(f if strand is None else f.where(F.col("strand") == strand))


def _genome(spark: SparkSession, sf_dir: str) -> str:
    def make(path: str) -> None:
        sizes = base._fragments(spark, sf_dir).groupBy("chrom").agg(F.max("end").alias("size"))
        lines = "transform(sequence(0L, (size - 1) div 60), i -> array_join(transform(sequence(i * 60, least(i * 60 + 59, size - 1)), p -> substr('ACGTN', cast((p * 7 + p div 3) % 5 + 1 AS int), 1)), ''))"
        sizes.selectExpr(f"concat('>', chrom, ' made\\n', array_join({lines}, '\\n')) AS value").coalesce(1).write.text(path)

    return _once(spark, sf_dir, "genome", make)


def _dataset(spark: SparkSession, sf_dir: str) -> str:
    def make(path: str) -> None:
        b = DatasetBuilder(spark, path, _genome(spark, sf_dir), WINDOW, resolution=RES, padding=PAD)
        b.add_runs("all", _depth(spark, sf_dir))
        b.add_runs("some", _depth(spark, sf_dir, "O"))
        b.finish()

    return _once(spark, sf_dir, "dataset", make)


@_query(f"WITH {GENOME} SELECT chrom, size FROM gs")
def fasta_sizes(spark, sf_dir):
    return fasta.sizes(spark, _genome(spark, sf_dir))


@_query(f"""WITH {GENOME}, p AS (SELECT chrom, unnest(generate_series(0, size - 1)) AS p FROM gs)
SELECT chrom, p // 700 AS chunk_id, string_agg({_LETTER.format("p")}, '' ORDER BY p) AS seq FROM p GROUP BY 1, 2""")
def fasta_chunks(spark, sf_dir):
    return fasta.read_fasta(spark, _genome(spark, sf_dir), 700)


@_query(f'WITH {GENOME} SELECT seg_idx, chrom, start, "end" FROM seg')
def store_segments(spark, sf_dir):
    return Store(spark, _dataset(spark, sf_dir)).segments()


@_query(f"""WITH {GENOME}, p AS (SELECT seg_idx, size, start + i AS p, i FROM seg, (SELECT unnest(generate_series(0, {WINDOW - 1})) AS i))
SELECT seg_idx, (i // 64)::INT AS split_idx, string_agg(CASE WHEN p < size THEN {_LETTER.format("p")} ELSE 'N' END, '' ORDER BY i) AS seq FROM p GROUP BY 1, 2""")
def store_sequences(spark, sf_dir):
    store = Store(spark, _dataset(spark, sf_dir), ReadOptions(window_size=64))
    return store.sequences(store.segments())


_READ = f"""rr AS (SELECT seg_idx, track_idx, (b - {PAD // RES}) // 2 AS r, {base._bf16("sum(m) / 2")} AS v FROM stored WHERE b >= {PAD // RES} AND b < {(PAD + WINDOW) // RES} GROUP BY 1, 2, 3)"""


@_query(f"""WITH {GENOME}, {TRACKS}, {_READ}
SELECT seg_idx, (r // 16)::INT AS split_idx, track_idx::INT AS track_idx, (r % 16 - 4)::INT AS i, least({base._bf16("v * 0.5")}, 40)::FLOAT AS v FROM rr WHERE r % 16 BETWEEN 4 AND 11""")
def store_values(spark, sf_dir):
    store = Store(spark, _dataset(spark, sf_dir), ReadOptions(resolution=8, window_size=128, target_length=64, scale=0.5, clamp_max=40.0))
    return store.values(store.segments()).select("seg_idx", "split_idx", "track_idx", F.posexplode("values").alias("i", "v"))


@_query(f"WITH {GENOME}, {TRACKS} SELECT seg_idx, track_idx::INT AS track, round(sum(m), 3) AS total FROM stored WHERE b >= {PAD // RES} AND b < {(PAD + WINDOW) // RES} GROUP BY 1, 2")
def store_stacked(spark, sf_dir):
    rows = Store(spark, _dataset(spark, sf_dir)).read().select("seg_idx", F.posexplode("values").alias("track", "v"))
    return rows.select("seg_idx", "track", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")), 3).alias("total"))


@_query(f"""WITH {GENOME}, {TRACKS}, p AS (SELECT * FROM stored WHERE seg_idx = 1 AND b >= {PAD // RES} AND b < {(PAD + WINDOW) // RES}), o AS (SELECT * FROM (VALUES (0, 1), (1, 0), (2, 1)) o(place, track_idx))
SELECT seg_idx, place::INT AS place, (b - {PAD // RES})::INT AS i, m::FLOAT AS v FROM p JOIN o USING (track_idx)""")
def store_point(spark, sf_dir):
    store = Store(spark, _dataset(spark, sf_dir))
    region = store.segments().where("seg_idx = 1").select(ranges.format_region()).first()[0]
    rows = store.point(region, ["some", 0, 1]).select("seg_idx", F.posexplode("values").alias("place", "v"))
    return rows.select("seg_idx", "place", F.posexplode("v").alias("i", "v"))


@_query(f"WITH {GENOME} SELECT t.track_idx::INT AS track_idx, track, (SELECT count(*) FROM seg) AS segments FROM (VALUES (0, 'all'), (1, 'some')) t(track_idx, track)")
def store_track_counts(spark, sf_dir):
    return Store(spark, _dataset(spark, sf_dir)).counts()


def _shift_sql(width: int, seed: int, epoch: int, key: str = "seg_idx") -> str:
    u = f"({base._DRAW(key, seed, epoch)} % {2 * width + 1} - {width})"
    return f"(sign({u}) * (abs({u}) // {RES}) * {RES})"


def _batches_sql(batch: int, workers: int, splits: int, source: str = "o") -> str:
    return f"""w AS (SELECT seg_idx, g, unnest(generate_series(0, {splits - 1})) AS split_idx FROM {source}),
pl AS (SELECT seg_idx, split_idx, g // {batch} % {workers} AS worker, (g // {batch} // {workers} * {batch} + g % {batch}) * {splits} + split_idx AS place FROM w),
ba AS (SELECT seg_idx, split_idx, dense_rank() OVER (ORDER BY place // {batch}, worker) - 1 AS batch_id, (place % {batch})::INT AS pos_in_batch FROM pl)"""


@_query(f"""WITH {GENOME}, {TRACKS}, o AS (SELECT seg_idx, row_number() OVER (ORDER BY {base._DRAW("seg_idx", 5, 2)}, seg_idx) - 1 AS g FROM seg), {_batches_sql(3, 2, 2)},
sh AS (SELECT seg_idx, {_shift_sql(8, 5, 2)} AS shift FROM seg),
su AS (SELECT seg_idx, track_idx, (b - {PAD // RES} - shift // {RES}) // 32 AS split_idx, sum(m) AS m FROM stored JOIN sh USING (seg_idx) WHERE b >= {PAD // RES} + shift // {RES} AND b < {(PAD + WINDOW) // RES} + shift // {RES} GROUP BY 1, 2, 3)
SELECT batch_id, pos_in_batch, seg_idx, split_idx::INT AS split_idx, round(sum(m), 3) AS total FROM ba JOIN su USING (seg_idx, split_idx) GROUP BY ALL""")
def loader_batches(spark, sf_dir):
    loader = Loader(spark, _dataset(spark, sf_dir), batch_size=3, n_jobs=2, window_size=128, shuffle=True, random_shift=8, random_seed=5)
    total = F.aggregate(F.flatten("values"), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return loader.batches(epoch=2).select("batch_id", "pos_in_batch", "seg_idx", "split_idx", F.round(total, 3).alias("total"))


@_query(f"""WITH {GENOME}, o AS (SELECT seg_idx, row_number() OVER (ORDER BY seg_idx) - 1 AS g FROM seg WHERE seg_idx % 3 = 1 AND seg_idx <> 4), {_batches_sql(2, 1, 1)}
SELECT batch_id, pos_in_batch, seg_idx FROM ba""")
def loader_subsets(spark, sf_dir):
    loader = Loader(spark, _dataset(spark, sf_dir), batch_size=2)
    every = loader.segment_rows()
    kept = loader.intersection(every.where("seg_idx % 3 = 1")).difference(every.where("seg_idx = 4"))
    return kept.batches().select("batch_id", "pos_in_batch", "seg_idx")


@_query(f"""WITH {GENOME}, {TRACKS}, v AS (SELECT ln(m + 1) AS v FROM stored WHERE seg_idx < 8 AND b >= {PAD // RES} AND b < {(PAD + WINDOW) // RES} AND m >= 1), s AS (SELECT min(v) AS lo, (max(v) - min(v)) / 12 AS width FROM v)
SELECT floor((v - lo) / width)::BIGINT AS bin, round(lo + floor((v - lo) / width) * width, 6) AS bin_start, round(lo + (floor((v - lo) / width) + 1) * width, 6) AS bin_end, count(*) AS count FROM v, s WHERE floor((v - lo) / width) < 12 GROUP BY ALL""")
def loader_hist(spark, sf_dir):
    out = Loader(spark, _dataset(spark, sf_dir), batch_size=4).hist(12, limit=2, min=1.0, log=True)
    return out.select("bin", F.round("bin_start", 6).alias("bin_start"), F.round("bin_end", 6).alias("bin_end"), "count")


@_query(f"""WITH {GENOME}, {TRACKS}, o AS (SELECT seg_idx, row_number() OVER (ORDER BY seg_idx) - 1 AS g FROM seg WHERE seg_idx <> 2), {_batches_sql(4, 1, 1)},
c AS (SELECT seg_idx, round(sum(m), 3) AS fine FROM stored WHERE b >= {PAD // RES} AND b < {(PAD + WINDOW) // RES} GROUP BY 1),
{_READ}, d AS (SELECT seg_idx, round(sum(least({base._bf16("v * 2")}, 100)), 3) AS coarse FROM rr GROUP BY 1)
SELECT batch_id, pos_in_batch, seg_idx, fine, coarse FROM ba JOIN c USING (seg_idx) JOIN d USING (seg_idx)""")
def map_batches(spark, sf_dir):
    where = _dataset(spark, sf_dir)
    both = LoaderMap({"fine": Loader(spark, where, batch_size=4), "coarse": Loader(spark, where, batch_size=9, resolution=8, scale=2.0, clamp_max=100.0)})
    skipped = both.loaders["fine"].segment_rows().where("seg_idx = 2")
    total = lambda c: F.round(F.aggregate(F.flatten(c), F.lit(0.0), lambda a, x: a + x.cast("double")), 3)
    rows = both.difference(skipped).batches()
    return rows.select("batch_id", "pos_in_batch", "seg_idx", total("values_fine").alias("fine"), total("values_coarse").alias("coarse"))


@_query(f"""WITH {GENOME}, a AS (SELECT seg_idx, row_number() OVER (ORDER BY seg_idx) - 1 AS g FROM seg), b AS (SELECT seg_idx, row_number() OVER (ORDER BY seg_idx) - 1 AS g FROM seg WHERE chrom = 'N')
SELECT g // 2 AS batch_id, 0 AS loader, (g % 2)::INT AS pos_in_batch, seg_idx FROM a UNION ALL SELECT g // 2, 1, (g % 2)::INT, seg_idx FROM b""")
def cat_batches(spark, sf_dir):
    loader = Loader(spark, _dataset(spark, sf_dir), batch_size=7, shuffle=True)
    some = loader.intersection(loader.segment_rows().where("chrom = 'N'"))
    return CatLoader([LoaderMap({"x": loader}), LoaderMap({"x": some})], batch_size=2, shuffle=False).batches().select("batch_id", "loader", "pos_in_batch", "seg_idx")


@_query("""WITH e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, embedding FROM embeddings), x AS (SELECT r, embedding, unnest(generate_series(1, 64)) AS i FROM e)
SELECT r // 48 AS batch_id, (r % 48)::INT AS pos_in_batch, (i - 1)::INT AS i, embedding[i]::FLOAT AS input, (embedding[i // 2 + 1] * 2)::FLOAT AS target FROM x""")
def array_batches(spark, sf_dir):
    def pieces():
        for at in range(0, len(rows), 130):
            x = rows[at : at + 130]
            yield x.reshape(-1, 8, 8), x * 2

    rows = np.array([r[0] for r in base._read(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").collect()], np.float32)
    path = scratch_dir(spark, "arrays")
    ArrayLoader(spark, pieces(), path)
    out = ArrayLoader.open(spark, path, 48).batches().select("batch_id", "pos_in_batch", "target", F.posexplode("input").alias("i", "input"))
    return out.select("batch_id", "pos_in_batch", "i", "input", F.get("target", F.floor((F.col("i") + 1) / 2).cast("int")).alias("target"))


# Signals in files


@_query(f"WITH {base.SIG} SELECT 't' AS track, chrom, pos AS start, pos + 1 AS \"end\", value::FLOAT AS value FROM sig WHERE chrom = 'click'")
def signal_store_runs(spark, sf_dir):
    return _signal_store(spark, sf_dir).get("click", "t")


def _signal_store(spark: SparkSession, sf_dir: str) -> SignalStore:
    def make(path: str) -> None:
        import_runs(base._signal(spark, sf_dir), SignalStore(spark, path, "w"), "t", codec=None)

    return SignalStore(spark, _once(spark, sf_dir, "signal", make))


@_query(f"""WITH {base.SIG}, v AS (SELECT value::FLOAT AS value FROM sig)
SELECT 't' AS track, min(value)::DOUBLE AS min, max(value)::DOUBLE AS max, round(sum(value::DOUBLE), 4) AS sum, round(avg(value::DOUBLE), 7) AS mean, round(sum((value * value)::DOUBLE) / count(*) - avg(value::DOUBLE) * avg(value::DOUBLE), 4) AS variance, count(*)::DOUBLE AS n FROM v""")
def signal_store_attrs(spark, sf_dir):
    out = _signal_store(spark, sf_dir).attrs()
    return out.select("track", "min", "max", F.round("sum", 4).alias("sum"), F.round("mean", 7).alias("mean"), F.round("variance", 4).alias("variance"), "n")


@_query("SELECT DISTINCT event_type AS chrom, event_type = 'click' AS held FROM events")
def signal_store_keys(spark, sf_dir):
    store = _signal_store(spark, sf_dir)
    return spark.createDataFrame([(k, k == "click" and "click" in store and "nowhere" not in store) for k in store.keys()], "chrom string, held boolean")


@_query(f'WITH {base.FRAG}, {base._sweep_sql("f")} SELECT chrom, start, "end", value::FLOAT AS value FROM ru WHERE "end" IS NOT NULL AND value <> 0')
def bigwig_runs(spark, sf_dir):
    def make(path: str) -> None:
        sizes = base._fragments(spark, sf_dir).groupBy("chrom").agg(F.max("end").alias("size"))
        bigwig.write_bigwig(_depth(spark, sf_dir), sizes, path.removeprefix("file://"), per_block=100)

    return bigwig.read_bigwig(spark, _once(spark, sf_dir, "bigwig", make).removeprefix("file://"))


@_query(base.ORACLE_SQL["cigar_insertion"])
def sam_insertions(spark, sf_dir):
    def make(path: str) -> None:
        line = F.concat_ws("\t", F.lit("r"), "flag", "chrom", "pos", F.lit("60"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"))
        head = spark.createDataFrame([("@HD\tVN:1.6",), ("",)], "value string")
        head.unionByName(base._reads(spark, sf_dir).select(line.alias("value"))).write.text(path)

    return coverage.insertions(bam.read_sam(spark, _once(spark, sf_dir, "sam", make)))


# Annotation in files

_KIND = "CASE WHEN c_acctbal > 5000 THEN 'protein_coding' WHEN c_acctbal > 0 THEN 'lncRNA' END"
_STRAND = "CASE WHEN c_custkey % 3 = 0 THEN '+' WHEN c_custkey % 3 = 1 THEN '-' ELSE '.' END"


def _gff(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(path: str) -> None:
        c = base._read(spark, sf_dir, "customer").selectExpr("c_custkey", "c_custkey * 100 + 1 AS l", "c_custkey * 100 + 50 AS r", f"{_STRAND} AS s", f"{_KIND} AS kind", "replace(c_name, '#', '%23') AS name")
        e = base._read(spark, sf_dir, "orders").selectExpr("o_custkey AS c_custkey", "o_orderkey % 1000 + 1 AS l", "o_orderkey % 1000 + 10 + o_orderkey % 7 AS r", "'+' AS s", "'' AS kind", "'x' AS name")

        def lines(df: DataFrame, kind: str, more: str) -> DataFrame:
            return df.selectExpr(f"concat_ws('\\t', 'chr', 'x', '{kind}', l, r, '.', s, '.', concat('gene_id=g', c_custkey, ';gene_name=', name, {more})) AS value")

        rows = lines(c, "gene", "coalesce(concat('; gene_type=', kind), '')").unionByName(lines(e, "exon", "''"))
        rows = rows.unionByName(lines(c, "transcript", "concat(';transcript_id=t', c_custkey, coalesce(concat(';transcript_type=', kind), ''))"))
        spark.createDataFrame([("##gff-version 3",)], "value string").unionByName(rows).write.option("compression", "gzip").text(path)

    return gff.read_gff(spark, _once(spark, sf_dir, "gff", make))


_TSS = "CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 100 WHEN c_custkey % 3 = 1 THEN c_custkey * 100 + 49 END"


@_query(f"""WITH x AS (SELECT DISTINCT o_custkey AS c, o_orderkey % 1000 AS start, o_orderkey % 1000 + 10 + o_orderkey % 7 AS "end" FROM orders), l AS (SELECT c, string_agg(start || '-' || "end", ',' ORDER BY start, "end") AS exons FROM x GROUP BY 1)
SELECT 'g' || c_custkey AS gene_id, c_name AS gene_name, ({_KIND}) = 'protein_coding' AS is_coding, 'chr' AS chrom, c_custkey * 100 AS start, c_custkey * 100 + 50 AS "end", nullif({_STRAND}, '.') AS strand, {_TSS} AS tss, exons FROM customer LEFT JOIN l ON c = c_custkey""")
def gff_genes(spark, sf_dir):
    out = annotation.read_genes(_gff(spark, sf_dir))
    return out.select("gene_id", "gene_name", "is_coding", "chrom", "start", "end", "strand", "tss", F.array_join(F.transform("exons", lambda e: F.format_string("%d-%d", e["start"], e["end"])), ",").alias("exons"))


@_query(f"""SELECT 't' || c_custkey AS transcript_id, NULL::VARCHAR AS transcript_name, 'g' || c_custkey AS gene_id, c_name AS gene_name, ({_KIND}) = 'protein_coding' AS is_coding, c_custkey * 100 AS start, c_custkey * 100 + 50 AS "end", nullif({_STRAND}, '.') AS strand, {_TSS} AS tss FROM customer""")
def gff_transcripts(spark, sf_dir):
    return annotation.read_transcripts(_gff(spark, sf_dir)).drop("line", "chrom")


# Small operators


@_query("SELECT p_partkey, 'c:' || p_brand AS chrom, p_partkey * 3 AS start, p_partkey * 3 + p_size AS \"end\" FROM part")
def region_parse(spark, sf_dir):
    rows = base._read(spark, sf_dir, "part").selectExpr("p_partkey", "concat('c:', p_brand, ':', p_partkey * 3, '-', p_partkey * 3 + p_size) AS region")
    return ranges.parse_regions(rows).drop("region")


@_query("SELECT event_id, CASE WHEN event_id % 5 < 3 THEN 0 ELSE value END::FLOAT AS value FROM events")
def import_clean(spark, sf_dir):
    odd = "CASE event_id % 5 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity') WHEN 2 THEN double('-Infinity') ELSE value END"
    return signal.clean_import(base._read(spark, sf_dir, "events").selectExpr("event_id", f"{odd} AS value"))


@_query("""WITH x AS (SELECT vec_id, embedding, vec_id % 90 - 10 AS a, vec_id % 90 - 10 + vec_id % 11 + 1 AS b FROM embeddings), y AS (SELECT vec_id, embedding, a, unnest(generate_series(a, b - 1)) AS p FROM x)
SELECT vec_id, (p - a)::INT AS i, CASE WHEN p >= 0 AND p < 64 THEN embedding[p + 1] ELSE -1 END::FLOAT AS v FROM y""")
def slice_pad(spark, sf_dir):
    rows = base._read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("e"))
    a = F.col("vec_id") % 90 - 10
    cut = arrays.slice_pad("e", a, a + F.col("vec_id") % 11 + 1, F.lit(-1.0).cast("float"))
    return rows.select("vec_id", F.posexplode(cut).alias("i", "v"))


@_query("SELECT label, vec_id, (i - 1)::INT AS i, embedding[i]::FLOAT AS v, (row_number() OVER (PARTITION BY label, i ORDER BY vec_id) - 1)::INT AS track FROM (SELECT label, vec_id, embedding, unnest(generate_series(1, 64)) AS i FROM embeddings)")
def stack_tracks(spark, sf_dir):
    rows = base._read(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("track_idx"), F.concat(F.array(F.col("vec_id").cast("float")), F.col("embedding").cast("array<float>")).alias("values"))
    stacked = rows.groupBy("label").agg(arrays.stack_tracks("track_idx", "values").alias("v")).select("label", F.posexplode("v").alias("track", "v"))
    return stacked.select("label", F.element_at("v", 1).cast("long").alias("vec_id"), "track", F.posexplode(F.slice("v", 2, 64)).alias("i", "v"))


_BPM_FIT = base._coverage_sql("1", 10).rsplit("\nSELECT", 1)[0]


@_query(f"""{_BPM_FIT}, k AS (SELECT sum(value * (("end" - start) // 10)) / 1000000.0::DOUBLE AS k FROM cl),
one AS (SELECT chrom, unnest(generate_series(start, "end" - 1)) AS pos, value FROM cl), spread AS (SELECT chrom, pos + d AS pos, value FROM one, (SELECT unnest(generate_series(-1, 2)) AS d))
SELECT chrom, pos, round(sum(value) / 4 / any_value(k), 4) AS value FROM spread JOIN fs USING (chrom), k WHERE pos >= 0 AND pos < size GROUP BY chrom, pos""")
def coverage_bpm_smooth(spark, sf_dir):
    f = base._fragments(spark, sf_dir)
    runs = coverage.coverage(f, base._fragment_sizes(f), 10, "BPM", smooth=4)
    return runs.select("chrom", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"), F.round("value", 4).alias("value"))
