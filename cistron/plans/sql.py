"""Pieces of DuckDB SQL to which queries are held."""

from __future__ import annotations

from ..functions import constants as K
from ..sources.sequences import ALPHABET, BASES

#: The derived sequences, as in sources.sequences.from_documents.
SEQS = f"""
letters AS (SELECT doc_id, lang, source, translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '{ALPHABET}', '{BASES}') AS dna FROM documents),
whole AS (SELECT doc_id AS seq_id, lang AS grp, source, left(dna, length(dna) - length(dna) % 3) AS raw FROM letters),
seqs AS (SELECT *, array_to_string(list_transform(regexp_extract_all(raw, '...'), lambda c: CASE c WHEN 'TAA' THEN 'CAA' WHEN 'TAG' THEN 'CAG' WHEN 'TGA' THEN 'CGA' ELSE c END), '') AS cds FROM whole)
"""


def values(name: str, columns: str, rows: list[tuple]) -> str:
    text = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else repr(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {text})"


CODON = values("codon", "codon, aa, freq, aa_max", [(c, K.AMINO[c], K.FREQ[c], K.AMINO_MAX[K.AMINO[c]]) for c in sorted(K.AMINO)])
WEIGHT = values("weight", "codon, w", sorted(K.WEIGHT.items()))
#: (seq_id, p, c): codons of cds and of raw, p from 1.
CDS_CODONS = "cc AS (SELECT seq_id, unnest(range(1, len(l) + 1)) AS p, unnest(l) AS c, len(l) AS n FROM (SELECT seq_id, regexp_extract_all(cds, '...') AS l FROM seqs))"
RAW_CODONS = "rc AS (SELECT seq_id, unnest(range(1, len(l) + 1)) AS p, unnest(l) AS c, len(l) AS n FROM (SELECT seq_id, regexp_extract_all(raw, '...') AS l FROM seqs))"
#: (seq_id, pair): codon pairs without the last.
PAIRS = "pairs AS (SELECT a.seq_id, a.c || b.c AS pair FROM cc a JOIN cc b ON a.seq_id = b.seq_id AND b.p = a.p + 1 WHERE a.p <= a.n - 2)"
COUNTS = "counts AS (SELECT pair, count(*) AS n FROM pairs GROUP BY pair), total AS (SELECT coalesce(sum(n), 0) AS total FROM counts)"
NAT = f"""nat AS (SELECT seqs.seq_id, coalesce(avg(ln((n + 1) / (total + {K.PAIR_VOCABULARY}))), 0) AS nat
  FROM seqs LEFT JOIN (SELECT * FROM pairs JOIN counts USING (pair), total) x USING (seq_id) GROUP BY seqs.seq_id)"""
CAI = "cai AS (SELECT seqs.seq_id, coalesce(pow(2, avg(log2(freq / aa_max))), 0) AS cai FROM seqs LEFT JOIN (SELECT * FROM cc JOIN codon ON cc.c = codon.codon) x USING (seq_id) GROUP BY seqs.seq_id)"
TAI = f"tai AS (SELECT seqs.seq_id, exp(avg(ln(greatest(w / {K.MAX_WEIGHT}, 1e-12)))) AS tai FROM seqs LEFT JOIN (SELECT * FROM cc JOIN weight ON cc.c = weight.codon) x USING (seq_id) GROUP BY seqs.seq_id)"
STATS = """stats AS (SELECT avg(nat) AS nat_mean, stddev_pop(nat) AS nat_std, avg(cai) AS cai_mean, stddev_pop(cai) AS cai_std, avg(tai) AS tai_mean, stddev_pop(tai) AS tai_std, count(tai) AS tai_n
  FROM nat JOIN cai USING (seq_id) JOIN tai USING (seq_id))"""
#: Everything up to calibrated scores of cds.
MEASURED = ",\n".join([SEQS, CODON, WEIGHT, CDS_CODONS, PAIRS, COUNTS, NAT, CAI, TAI, STATS])


def count_of(s: str, m: str) -> str:
    return f"((length({s}) - length(replace({s}, '{m}', ''))) // {len(m)})"


def sites(s: str, motifs=K.MOTIFS) -> str:
    return "(" + " + ".join(count_of(s, m) for m in motifs) + ")"


def runs(s: str, least: int) -> str:
    return f"len(regexp_extract_all({s}, 'A{{{least},}}|C{{{least},}}|G{{{least},}}|T{{{least},}}'))"


def max_run(s: str, b: str) -> str:
    return f"coalesce(list_max(list_transform(regexp_extract_all({s}, '{'|'.join(x + '+' for x in b)}'), lambda r: length(r))), 0)"


def letters(s: str, some: str) -> str:
    return f"(length({s}) - length(translate({s}, '{some}', '')))"


def gc(s: str) -> str:
    return f"(CASE WHEN length({s}) = 0 THEN 0.0 ELSE {letters(s, 'GC')}::DOUBLE / length({s}) END)"


def odds(s: str, a: str, b: str) -> str:
    return f"(CASE WHEN {letters(s, a)} * {letters(s, b)} = 0 THEN 0.0 ELSE {count_of(s, a + b)}::DOUBLE / ({letters(s, a)}::DOUBLE * {letters(s, b)} / length({s})) END)"


def gc_penalty(g: str) -> str:
    return f"{K.W_GC} * (greatest(0, {g} - {K.GC_HI}) + greatest(0, {K.GC_LO} - {g}))"


#: (seq_id, hi, lo): sliding GC of `raw` or `cds`, over blocks of the step.
def slide(column: str) -> str:
    return f"""blocks AS (SELECT seq_id, unnest(range(1, len(l) + 1)) AS p, unnest(l) AS b, len(l) AS n FROM (SELECT seq_id, regexp_extract_all({column}, '.{{10}}') AS l FROM seqs)),
sums AS (SELECT seq_id, p, n, sum({letters('b', 'GC')}) OVER (PARTITION BY seq_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) / 60.0 AS g FROM blocks),
slide AS (SELECT seqs.seq_id, CASE WHEN length({column}) <= 60 THEN {gc(column)} ELSE max(g) END AS hi, CASE WHEN length({column}) <= 60 THEN {gc(column)} ELSE min(g) END AS lo
  FROM seqs LEFT JOIN (SELECT * FROM sums WHERE p <= n - 5) x ON x.seq_id = seqs.seq_id GROUP BY seqs.seq_id, {column})"""


#: (seq_id, urich): 6-letter windows with four T or more.
def urich(column: str) -> str:
    return f"""bases AS (SELECT seq_id, unnest(range(1, len(l) + 1)) AS p, unnest(l) AS b, len(l) AS n FROM (SELECT seq_id, string_split({column}, '') AS l FROM seqs WHERE {column} <> '')),
six AS (SELECT seq_id, p, n, sum((b = 'T')::INT) OVER (PARTITION BY seq_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS t FROM bases),
urich AS (SELECT seqs.seq_id, count(x.p) AS urich FROM seqs LEFT JOIN (SELECT * FROM six WHERE t >= 4 AND p <= n - 5) x USING (seq_id) GROUP BY seqs.seq_id)"""


ENC = f"""hist AS (SELECT seq_id, aa, c, count(*) AS k FROM rc JOIN codon ON rc.c = codon.codon WHERE aa NOT IN ('*', 'M', 'W') GROUP BY ALL),
per_aa AS (SELECT seq_id, aa, sum(k) AS n, sum(k * k) AS kk FROM hist GROUP BY ALL),
fam AS (SELECT seq_id, family, avg(CASE WHEN n = 1 THEN 1.0 ELSE (n * (kk::DOUBLE / (n * n)) - 1) / (n - 1) END) AS f
  FROM per_aa JOIN (SELECT aa, count(*) AS family FROM codon GROUP BY aa) s USING (aa) GROUP BY ALL),
enc AS (SELECT seqs.seq_id, least(61.0, 2.0 + {' + '.join(f'{w} / greatest(coalesce(max(CASE WHEN family = {s} THEN f END), 1.0), 1e-6)' for s, w in ((2, 9.0), (3, 1.0), (4, 5.0), (6, 3.0)))}) AS enc
  FROM seqs LEFT JOIN fam USING (seq_id) GROUP BY seqs.seq_id)"""
SCORED = f"""{MEASURED},
z AS (SELECT seqs.*, nat, cai, tai, (nat - nat_mean) / nat_std AS z_nat, (cai - cai_mean) / cai_std AS z_cai, (coalesce(tai, 0) - tai_mean) / tai_std AS z_tai,
  {sites('cds')} AS sites, {runs('cds', 4)} AS hp4, {runs('cds', 5)} AS hp5, {gc('cds')} AS gc
  FROM seqs JOIN nat USING (seq_id) JOIN cai USING (seq_id) JOIN tai USING (seq_id), stats),
scored AS (SELECT *, z_nat + z_cai - penalty AS score_v2, z_nat + z_cai - penalty + {K.W_TAI} * z_tai AS score_v25
  FROM (SELECT *, {K.W_SITE} * sites + {K.W_HP4} * hp4 + {K.W_HP5} * hp5 + {gc_penalty('gc')} AS penalty FROM z))"""
