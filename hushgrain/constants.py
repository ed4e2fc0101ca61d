"""Fixed values of the read classification: categories, thresholds, sequences, bins.

All names and numbers below are fixed values that results have to agree with.
"""

# --- categories, in the order in which results list them (fixed values) ---
CATEGORY_ORDER = (
    "exonic_sense",
    "exonic_antisense",
    "intronic_jxnspan",
    "intronic_pure",
    "intronic_boundary",
    "intergenic_sparse",
    "intergenic_repeat",
    "intergenic_hotspot",
    "intergenic_novel",
    "chimeric",
    "mitochondrial",
    "multimapper",
    "ambiguous",
    "ambiguous_cod_ncod",
    "ambiguous_cod_cod",
    "unassigned",
)
DROPPED = ("unmapped", "secondary", "supplementary")
NOISE = ("exonic_antisense", "intronic_pure", "intronic_boundary", "intergenic_sparse", "intergenic_repeat", "intergenic_hotspot", "chimeric")
NOISE_STRICT = tuple(c for c in NOISE if c not in ("intronic_pure", "intronic_boundary"))
NOISE_UNSTRANDED = tuple(c for c in NOISE if c != "exonic_antisense")
NOISE_STRICT_UNSTRANDED = tuple(c for c in NOISE_STRICT if c != "exonic_antisense")
AMBIGUOUS_SET = ("intronic_jxnspan", "intergenic_novel", "ambiguous", "ambiguous_cod_cod", "ambiguous_cod_ncod")
PLATFORMS = ("ont", "pacbio", "illumina", "illumina_10x", "illumina_bd", "smartseq", "unknown")
STAGES = ("raw", "pre_filter", "post_filter", "custom")

# --- flags ---
FLAG_PAIRED, FLAG_PROPER, FLAG_UNMAPPED, FLAG_MATE_UNMAPPED, FLAG_REVERSE, FLAG_READ1 = 0x1, 0x2, 0x4, 0x8, 0x10, 0x40
FLAG_SECONDARY, FLAG_SUPPLEMENTARY = 0x100, 0x800
FLAG_SKIPPED = FLAG_UNMAPPED | FLAG_SECONDARY | FLAG_SUPPLEMENTARY

# --- thresholds (fixed values) ---
CHIMERIC_DISTANCE = 10_000
MAX_TLEN = 1_000_000
TSO_PREFIX = "AAGCAGTGGTAT"
POLY_G = "GGGGGG"
POLYA_RUN, POLYA_WINDOW = 6, 20
LOCUS_GAP = 500
LOCUS_ALPHA, LOCUS_MIN_READS, LOCUS_MIN_BARCODES, LOCUS_BARCODE_FRACTION = 0.01, 5, 3, 1e-4
POLYA_SITE_DISTANCE, TSS_DISTANCE = 50, 100
LENGTH_BREAKS = (150, 500, 1000, 2000, 5000)
LENGTH_LABELS = ("<150", "150\u2013500", "500\u20131000", "1000\u20132000", "2000\u20135000", ">5000")
LENGTH_LABELS_MERGED = ("<500", "500\u20131000", "1000\u20132000", "2000\u20135000", ">5000")
SHORT_READ_MEDIAN, DEFAULT_MEDIAN = 300, 1000
MIN_CELL_READS = 10
MIN_CONTIG_LENGTH = 1_000_000
MITO_CONTIGS = ("chrM", "MT", "chrMT", "mitochondrion")
CANONICAL_DONORS = ("GT", "GC", "AT")
CODING_BIOTYPES = (
    "protein_coding",
    "IG_C_gene",
    "IG_D_gene",
    "IG_J_gene",
    "IG_V_gene",
    "TR_C_gene",
    "TR_D_gene",
    "TR_J_gene",
    "TR_V_gene",
)
NO_BARCODE = "NO_BARCODE"
FULL_LENGTH_MIN = {"ont": 500, "pacbio": 1000}
FULL_LENGTH_MIN_DEFAULT = 500
INSERT_MAX = 2000
VERSION_GAP = 5
