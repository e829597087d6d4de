"""The engine's input tables, derived from the driver's tables by SQL that Spark and DuckDB both read.

Every row of the base tables takes part. {table} stands for a base table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_CHUNK = "translate(md5(concat(chrom, ':', {c})), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _bases(pos: str, n: int) -> str:
    """SQL for n bases of the made-up reference from pos on."""
    first = f"CAST(floor(({pos}) / 32) AS BIGINT)"
    chunks = ", ".join(_CHUNK.replace("{c}", f"{first} + {i}") for i in range((n + 62) // 32))
    return f"substr(concat({chunks}), CAST(({pos}) % 32 AS INT) + 1, {n})"


_READS = """SELECT concat(l_orderkey, '_', l_linenumber, '_', l_partkey, '_', l_suppkey) AS name, concat('chr', l_suppkey % 5 + 1) AS chrom,
 l_partkey * 50 + l_linenumber * 7 AS ref_start, l_partkey * 50 + l_linenumber * 7 + 100 + CAST(10 * floor(l_quantity) AS BIGINT) AS ref_end,
 CAST(l_orderkey % 61 AS INT) AS mapq,
 CAST(99 + CASE WHEN l_orderkey % 23 = 0 THEN 1024 ELSE 0 END + CASE WHEN l_orderkey % 29 = 0 THEN 256 ELSE 0 END - CASE WHEN l_orderkey % 31 = 0 THEN 2 ELSE 0 END AS INT) AS flag,
 l_discount >= 0.08 AS has_sa, CAST(l_linenumber AS INT) AS line, CAST(l_orderkey % 2 AS INT) AS hap, CAST(floor(l_extendedprice) AS BIGINT) AS ord
 FROM {lineitem}"""

_SITE = "CAST(floor((pos + 499) / 500) AS BIGINT) * 500"
_ALN = f"""SELECT name, read_num, flag, chrom, pos, mapq, cigar, mate_pos, tlen, ord,
 CASE WHEN hap = 1 AND {_SITE} - pos < 50 THEN concat(substr(s, 1, CAST({_SITE} - pos AS INT)), translate(substr(s, CAST({_SITE} - pos AS INT) + 1, 1), 'ACGT', 'CATG'), substr(s, CAST({_SITE} - pos AS INT) + 2)) ELSE s END AS seq,
 substr(translate(concat(md5(concat(name, '/', read_num)), md5(concat(name, '+', read_num))), '0123456789abcdef', '#+-05:<=>?@ABCFI'), 1, 50) AS qual,
 CASE WHEN has_sa THEN 'chr1,1,+,50M,0,0;' END AS sa
 FROM (SELECT *, {_bases('pos', 50)} AS s FROM (
 SELECT name, 1 AS read_num, flag, chrom, ref_start AS pos, mapq, line, hap, has_sa, ref_end - 50 AS mate_pos, CAST(ref_end - ref_start AS INT) AS tlen, ord,
  CASE line % 7 WHEN 0 THEN '50M' WHEN 1 THEN '5S45M' WHEN 2 THEN '20M2I28M' WHEN 3 THEN '20M3D30M' WHEN 4 THEN '45M5S' WHEN 5 THEN '10=1X39M' ELSE '25M100N25M' END AS cigar FROM reads
 UNION ALL
 SELECT name, 2 AS read_num, flag + 48 AS flag, chrom, ref_end - 50 AS pos, mapq, line, hap, has_sa, ref_start AS mate_pos, CAST(ref_start - ref_end AS INT) AS tlen, ord,
  CASE line % 3 WHEN 0 THEN '50M' WHEN 1 THEN '48M2S' ELSE '30M1D20M' END AS cigar FROM reads) a) b"""

_SV = f"""SELECT event_id, sv_type, chrom, start, CASE WHEN sv_type IN ('INS', 'BND') THEN start WHEN sv_type = 'SNP' THEN start + 1 ELSE start + 500 + 40 * size END AS "end",
 CASE WHEN sv_type = 'BND' THEN concat('chr', event_id % 3 + 1) END AS chrom_b, CASE WHEN sv_type = 'BND' THEN start + 700 END AS bp_b, sv_type = 'BND' AND size % 2 = 0 AS inverted,
 CASE WHEN sv_type = 'INS' THEN substr(translate(md5(concat('ins', event_id)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 5 + size % 20) END AS ins_seq,
 CASE WHEN sv_type = 'INS' THEN CAST(5 + size % 20 AS BIGINT) END AS ins_len,
 CASE WHEN sv_type = 'SNP' THEN {_bases('start', 1)} END AS ref_allele, CASE WHEN sv_type = 'SNP' THEN translate({_bases('start', 1)}, 'ACGT', 'CATG') END AS alt_allele,
 concat('GENE', event_id % 40) AS gene, CAST(10 + 10 * (size % 9) AS DOUBLE) / 100 AS vaf
 FROM (SELECT CAST(p_partkey AS BIGINT) AS event_id, concat('chr', p_partkey % 5 + 1) AS chrom, p_partkey * 50 AS start, CAST(p_size AS INT) AS size,
 CASE p_partkey % 6 WHEN 0 THEN 'DEL' WHEN 1 THEN 'DUP' WHEN 2 THEN 'INV' WHEN 3 THEN 'INS' WHEN 4 THEN 'SNP' ELSE 'BND' END AS sv_type FROM {{part}}) e"""

_REF = f"SELECT chrom, chunk_id, {_CHUNK.replace('{c}', 'chunk_id')} AS seq FROM (SELECT concat('chr', k) AS chrom, p_partkey * 2 + i AS chunk_id FROM {{part}} CROSS JOIN (VALUES (1), (2), (3), (4), (5)) c(k) CROSS JOIN (VALUES (0), (1)) h(i)) r"

_T = "chr(9)"
_VCF = f"""SELECT CAST(p_partkey AS BIGINT) AS line_no, CASE WHEN p_partkey % 50 = 0 THEN '#comment' ELSE concat_ws({_T}, concat('chr', p_partkey % 5 + 1), CASE WHEN p_partkey % 41 = 0 THEN '0' ELSE CAST(p_partkey * 50 AS STRING) END,
 CASE WHEN p_partkey % 19 = 0 THEN '.' ELSE concat('v', p_partkey) END, CASE WHEN p_partkey % 7 = 5 THEN 'A' WHEN p_partkey % 7 = 6 THEN 'acg' ELSE 'N' END,
 CASE p_partkey % 7 WHEN 0 THEN '<DEL>' WHEN 1 THEN '<DUP>' WHEN 2 THEN '<INV>' WHEN 3 THEN CASE WHEN p_size % 2 = 0 THEN '<INS>' ELSE 'NACGTT' END
  WHEN 4 THEN CASE p_size % 4 WHEN 0 THEN concat('N[chr2:', p_size * 10, '[') WHEN 1 THEN concat(']chr3:', p_size * 10, ']N') WHEN 2 THEN concat('N]chr4:', p_size * 10, ']') ELSE concat('[chr5:', p_size * 10, '[N') END
  WHEN 5 THEN CASE WHEN p_size % 3 = 0 THEN 'A,T' ELSE 'T' END ELSE 'a' END,
 '50', 'PASS', concat(CASE p_partkey % 7 WHEN 0 THEN 'SVTYPE=DEL' WHEN 1 THEN 'SVTYPE=DUP' WHEN 2 THEN 'SVTYPE=INV' WHEN 3 THEN 'SVTYPE=INS' WHEN 4 THEN concat('SVTYPE=BND;MATEID=v', p_partkey + CASE WHEN p_partkey % 2 = 0 THEN 7 ELSE -7 END) ELSE 'DP=10' END,
  CASE WHEN p_size % 3 = 0 THEN concat(';END=', p_partkey * 50 + 100 + p_size) ELSE '' END, CASE WHEN p_size % 5 < 3 THEN concat(';SVLEN=', CASE WHEN p_size % 2 = 0 THEN -1 ELSE 1 END * p_size * 30) ELSE '' END,
  CASE WHEN p_size % 7 = 0 THEN ';SIM_VAF=1.5' ELSE '' END, CASE WHEN p_size % 4 = 1 THEN concat(';VAF=0.', p_size) ELSE '' END, CASE WHEN p_size % 4 = 2 THEN ';AF=0.25' ELSE '' END, CASE WHEN p_size % 6 < 2 THEN concat(';SIM_GENE=G', p_size) ELSE '' END),
 'GT:AD', concat(CASE p_size % 5 WHEN 0 THEN '0/1' WHEN 1 THEN '1|0' WHEN 2 THEN '1/1' WHEN 3 THEN '0|1' ELSE './.' END, ':3,4')) END AS line FROM {{part}}"""

_BED = f"SELECT CAST(p_partkey AS BIGINT) AS line_no, CASE WHEN p_partkey % 60 = 0 THEN '# note' WHEN p_partkey % 61 = 0 THEN 'track name=x' WHEN p_partkey % 62 = 0 THEN '' ELSE concat_ws({_T}, concat('chr', p_partkey % 5 + 1), CAST(p_partkey * 50 AS STRING), CAST(p_partkey * 50 + 20 + p_size AS STRING), concat('G', p_partkey % 25, '_exon', p_size)) END AS line FROM {{part}}"
_EXONS = f"SELECT line_no, split_part(line, {_T}, 1) AS chrom, CAST(split_part(line, {_T}, 2) AS BIGINT) AS start, CAST(split_part(line, {_T}, 3) AS BIGINT) AS \"end\", split_part(line, {_T}, 4) AS name, split_part(split_part(line, {_T}, 4), '_', 1) AS gene FROM bed WHERE line <> '' AND substr(line, 1, 1) <> '#' AND substr(line, 1, 5) <> 'track'"
_SPANS = "SELECT CAST(event_id AS BIGINT) AS id, event_type AS chrom, CAST(event_id AS BIGINT) * 97 % 50000 AS start, CAST(event_id AS BIGINT) * 97 % 50000 + 5 + CAST(user_id % 40 AS BIGINT) AS \"end\" FROM {events}"
_DNA = "SELECT doc_id, regexp_replace(upper(coalesce(text, '')), '[^ACGTN]', ''{g}) AS seq FROM {documents}"
_PAIRS = "SELECT name, chrom, ref_start, ref_end, ref_end - ref_start AS insert_size, hap, ord FROM reads"

VIEWS = {"reads": _READS, "aln": _ALN, "sv": _SV, "ref": _REF, "vcf": _VCF, "bed": _BED, "exons": _EXONS, "spans": _SPANS, "dna": _DNA, "pairs": _PAIRS}
_NEEDS = {"aln": ["reads"], "pairs": ["reads"], "exons": ["bed"]}
_TABLES = ("lineitem", "part", "events", "documents")


def table(spark: SparkSession, path: str) -> DataFrame:
    """A table; one of fewer files than the session has cores is dealt to all of them, since one row group is one task."""
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: table(spark, f"{sf_dir}/{t}.parquet") for t in _TABLES if f"{{{t}}}" in VIEWS[name]}
    below = {n: view(spark, sf_dir, n) for n in _NEEDS.get(name, [])}
    text = VIEWS[name].replace("{g}", "").replace('"end"', "`end`")
    for n in below:
        text = re.sub(rf"\bFROM {n}\b", f"FROM {{{n}}}", text)
    return spark.sql(text, **tables, **below)


def _counts(sql: str) -> str:
    """count_if(x) as count(CASE WHEN x THEN 1 END): DuckDB's own gives a HUGEINT."""
    while (at := sql.find("count_if(")) >= 0:
        depth, i = 1, at + 9
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + 9 : i - 1]} THEN 1 END){sql[i:]}"
    return sql


def oracle(body: str) -> str:
    """DuckDB SQL: body after the views that it names."""
    body = _counts(body)
    wanted: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in wanted:
            wanted.append(n)

    for n in VIEWS:
        if re.search(rf"\b{n}\b", body):
            add(n)
    texts = {n: VIEWS[n].replace("{g}", ", 'g'") for n in wanted}
    for n in texts:
        for t in _TABLES:
            texts[n] = texts[n].replace(f"{{{t}}}", t)
    ctes = [f"{n} AS ({texts[n]})" for n in wanted]
    recursive = "RECURSIVE " if "-- recursive" in body else ""
    lead = re.match(r"\s*WITH (.*)", body, re.S)
    if lead:
        return f"WITH {recursive}" + ",\n".join([*ctes, lead[1]])
    return (f"WITH {recursive}" + ",\n".join(ctes) + "\n" if ctes else "") + body
