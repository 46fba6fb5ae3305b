"""They decide the results, so they are stated here as plain text."""

WINDOW = 194          # width of a scored window, nt
STEP = 5              # default distance between scored windows
MIN_BOX_DIST = 15     # a box lies at least this far from the window middle
FLANK = 20            # no box in the first / last nt of a window
KMER = 6              # tokens are overlapping 6-mers

# Box consensus; R stands for A or G.
C_BOX = "RTGATGA"
D_BOX = "CTGA"
C_BOX_MISSING = "NNNNNNN"
D_BOX_MISSING = "NNNN"
C_MAX_SUBS = 3
D_MAX_SUBS = 2

# IUPAC complement; S, W and N map to themselves.
COMPLEMENT_FROM = "ACGTRYKMBDHV"
COMPLEMENT_TO = "TGCAYRMKVHDB"

SAVGOL_WIDTH = 11     # smoothing fits a parabola to 11 points

PEAK_HEIGHT = 0.005
PEAK_DROP = 0.00001

PROB_FIRST = 0.999
PROB_FIRST_RELAXED = 0.9   # BED input, or when no contig is longer than a window
PROB_SECOND = 0.999
CONSECUTIVE_WINDOWS = 10
BOX_SCORE = 5
SCORE_C = 2
SCORE_D = 1
TERMINAL_STEM_SCORE = -25.0
SNO_STABILITY = -0.2

EXPRESSED = "expressed_CD_snoRNA"
PSEUDOGENE = "CD_snoRNA_pseudogene"
POSITIVE_LABEL = "CD_snoRNA"
NEGATIVE_LABEL = "Other"
