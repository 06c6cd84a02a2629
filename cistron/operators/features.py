"""The feature table: everything that is known of a sequence, in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codon as C
from ..functions import sequence as S
from . import structure


def featurize(rows: DataFrame, backend: structure.Backend | None = None, seq: str = "cds") -> DataFrame:
    """Columns of the sequence, its codons, structure and rules, beside those of a folding dump where there are some.

    rows: seq_id, source, lam, aa (the protein or null) and `seq`, mfe_reported, cai_reported (null without a dump).
    """
    s = F.col(seq)
    rules = S.rule_features(s)
    rules.pop("urich6_count")
    names = {"paired_fraction": "paired_frac_mfe", "longest_helix": "longest_helix_mfe", "n_helices8": "n_helix_ge8"}
    folded = structure.structure_features(rows.select("seq_id", seq), backend, seq).withColumnsRenamed(names)
    meta = {"protein_len": F.length("aa"), "stop_codon": C.stop_codon(s), "translate_ok": F.when(F.col("aa").isNotNull(), C.check_translate(s, F.col("aa")).cast("int"))}
    made = meta | S.seq_features(s) | C.codon_features(s) | rules
    out = rows.select("seq_id", "source", "lam", *(c.alias(n) for n, c in made.items()), "mfe_reported", "cai_reported").join(folded, "seq_id")
    return out.withColumns({"delta_mfe": F.col("mfe") - F.col("mfe_reported"), "delta_cai": F.col("cai") - F.col("cai_reported")})
