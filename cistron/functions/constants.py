"""Tables, motifs and weights that results must agree on."""

from __future__ import annotations

# --- fixed values -------------------------------------------------------------------------------------------------
#: Codon, amino acid (* is stop), frequency among the codons of that amino acid, in human coding sequences.
CODON_USAGE = """
UAA * 0.28
UAG * 0.2
UGA * 0.52
GCU A 0.26
GCC A 0.4
GCA A 0.23
GCG A 0.11
UGU C 0.45
UGC C 0.55
GAU D 0.46
GAC D 0.54
GAA E 0.42
GAG E 0.58
UUU F 0.45
UUC F 0.55
GGU G 0.16
GGC G 0.34
GGA G 0.25
GGG G 0.25
CAU H 0.41
CAC H 0.59
AUU I 0.36
AUC I 0.48
AUA I 0.16
AAA K 0.42
AAG K 0.58
UUA L 0.07
UUG L 0.13
CUU L 0.13
CUC L 0.2
CUA L 0.07
CUG L 0.41
AUG M 1
AAU N 0.46
AAC N 0.54
CCU P 0.28
CCC P 0.33
CCA P 0.27
CCG P 0.11
CAA Q 0.25
CAG Q 0.75
CGU R 0.08
CGC R 0.19
CGA R 0.11
CGG R 0.21
AGA R 0.2
AGG R 0.2
UCU S 0.18
UCC S 0.22
UCA S 0.15
UCG S 0.06
AGU S 0.15
AGC S 0.24
ACU T 0.24
ACC T 0.36
ACA T 0.28
ACG T 0.12
GUU V 0.18
GUC V 0.24
GUA V 0.11
GUG V 0.47
UGG W 1
UAU Y 0.43
UAC Y 0.57
"""
#: Anticodon and gene copies of human tRNAs; TCA, which reads a stop codon, is left out.
TRNA_COPIES = """
AAA 0 AAC 9 AAG 9 AAT 15 ACG 7 ACT 0 AGA 9 AGC 26 AGG 9 AGT 9 ATA 0 ATC 0 ATG 0 ATT 0
CAA 6 CAC 13 CAG 9 CAT 20 CCA 7 CCC 5 CCG 4 CCT 5 CGA 4 CGC 4 CGG 4 CGT 5 CTA 0 CTC 8 CTG 13 CTT 15
GAA 10 GAC 0 GAG 0 GAT 3 GCA 29 GCC 14 GCG 0 GCT 8 GGA 0 GGC 0 GGG 0 GGT 0 GTA 13 GTC 13 GTG 9 GTT 25
TAA 4 TAC 5 TAG 3 TAT 5 TCC 9 TCG 6 TCT 6 TGA 4 TGC 8 TGG 7 TGT 6 TTA 0 TTC 8 TTG 6 TTT 12
"""
#: Penalty by base 34 of the anticodon (I: inosine, which A becomes) and third base of the codon, in DNA letters.
WOBBLE = """
C A 1.0
C C 1.0
C G 0.0
C T 1.0
G A 1.0
G C 0.0
G G 1.0
G T 0.5
T A 0.0
T C 1.0
T G 0.5
T T 1.0
I A 0.0
I C 0.0
I G 1.0
I T 0.5
"""
#: Recognition sites that a manufactured sequence must not have, and splice donors.
MOTIFS = ("GGTCTC", "GAGACC", "CGTCTC", "GAGACG", "GAATTC", "CTCGAG", "GGATCC", "GCGGCCGC")
DONORS = ("GTAAGT", "GTGAGT")
STOPS = ("TAA", "TAG", "TGA")
#: Weights of the design score.
W_SITE, W_HP4, W_HP5, W_GC, W_TAI, W_EXPR, W_STAB = 0.5, 0.1, 0.8, 5.0, 1.0, 0.6, 0.4
GC_LO, GC_HI, SLIDE_LO, SLIDE_HI = 0.30, 0.70, 0.20, 0.80
GC_WINDOW, GC_STEP = 60, 10
#: Longest run of one base: for the rules, and from which the hard gate fails.
RULE_RUN, HARD_RUN = 3, 5
#: Codon pairs there are, for smoothing.
PAIR_VOCABULARY = 4096
#: Duplexes: seed, mismatches, bases between the arms' starts beyond the seed; repair: aim, least, rounds, near, gates.
SEED, MISMATCHES, GAP = 10, 2, 3
REPAIR_AIM, REPAIR_LEAST, REPAIR_ROUNDS, REPAIR_NEAR = 12, 15, 15, 3
GATE_SCORE, GATE_NAT, GATE_CAI = 0.10, 0.05, 0.005
REFINE_ROUNDS, LEAST_GAIN = 8, 1e-6
#: Diversity selection and scorecard.
TOP_K, ALPHA, TIE_BAND, LEAST_STD = 5, 0.5, 0.5, 1e-9
DUPLEX_MED, DUPLEX_HIGH, URICH_PER_KB, CPG_HIGH = 24, 30, 25.0, 1.6
# ------------------------------------------------------------------------------------------------------------------

_ROWS = [line.split() for line in CODON_USAGE.split("\n") if line]
#: By DNA codon: amino acid, frequency, greatest frequency of the amino acid's codons.
AMINO = {c.replace("U", "T"): a for c, a, _ in _ROWS}
FREQ = {c.replace("U", "T"): float(f) for c, _, f in _ROWS}
AMINO_MAX = {a: max(FREQ[c] for c in FREQ if AMINO[c] == a) for a in AMINO.values()}
#: Best codon of each amino acid, and all of them in order.
BEST = {a: max((c for c in AMINO if AMINO[c] == a), key=FREQ.get) for a in sorted(set(AMINO.values()) - {"*"})}
SYNONYMS = {a: sorted(c for c in AMINO if AMINO[c] == a) for a in BEST}
_FIELDS = TRNA_COPIES.split()
COPIES = {a: float(n) for a, n in zip(_FIELDS[::2], _FIELDS[1::2], strict=True)}
PENALTY = {(x.split()[0], x.split()[1]): float(x.split()[2]) for x in WOBBLE.split("\n") if x}
_COMPLEMENT = str.maketrans("ACGT", "TGCA")


def codon_weight(codon: str) -> float:
    """Supply of tRNAs for a codon: copies of those whose last two bases pair with its first two, less the wobble."""
    tail = codon[:2].translate(_COMPLEMENT)[::-1]
    found = ((copies, PENALTY.get(("I" if a[0] == "A" else a[0], codon[2]), 1.0)) for a, copies in COPIES.items() if a[1:] == tail)
    return sum(copies * (1 - s) for copies, s in found if s < 1)


WEIGHT = {c: codon_weight(c) for c in AMINO if AMINO[c] != "*"}
MAX_WEIGHT = max(WEIGHT.values())
FAMILY = {a: len(v) for a, v in SYNONYMS.items()}
