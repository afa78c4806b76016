"""The format's block ids and the words that results use."""

# Framing of a PD0 record.
SYNC = b"\x7f\x7f"
FIXED_LEADER, VARIABLE_LEADER, BOTTOM_TRACK = "0000", "8000", "0006"
#: Blocks that grow with the number of depth cells: name and bytes for each beam and cell.
CELL_BLOCKS = {"0001": ("Velocity", 2), "0002": ("Correlation", 1), "0003": ("Echo Intensity", 1), "0004": ("Percent Good", 1)}

# Regions of a file.
VALID, TRUNCATED, NON_PD0, FRAGMENT, BAD_CHECKSUM = (
    "VALID_ENSEMBLE", "TRUNCATED_ENSEMBLE", "NON_PD0_DATA", "POSSIBLE_FRAGMENT", "BAD_CHECKSUM",
)

# Statuses of a boundary between files, the most important first.
BOUNDARY_ORDER = [
    "CONFLICT", "AMBIGUOUS", "SAFE_SPLIT_RECONSTRUCTION", "CONFIGURATION_CHANGE", "EXACT_OVERLAP", "PARTIAL_OVERLAP", "GAP",
    "CLEAN_WITH_COUNTER_RESET", "CLEAN_CONTIGUOUS", "TRUNCATED_PREVIOUS_FILE", "TRUNCATED_NEXT_FILE", "UNRECOVERABLE_FRAGMENT",
]

# Verdicts, split statuses, discovery.
PASS, PASS_WITH_GAPS, PASS_WITH_FRAGMENTS, REVIEW, FAIL = (
    "PASS", "PASS_WITH_GAPS", "PASS_WITH_UNRECOVERABLE_FRAGMENTS", "MANUAL_REVIEW_REQUIRED", "FAIL",
)
SAFE_SPLIT, REJECTED_SPLIT = "SAFE_RECONSTRUCTION", "REJECTED"
NO_INPUT, SEVERAL_GROUPS = "NO_INPUT_FILES_FOUND", "MULTIPLE_CANDIDATE_DATASETS"
ONE_GROUP = "ONE_GROUP"  # of this library: the group itself is the answer
OUTPUT_DIRECTORIES, OUTPUT_NAME = ("output", "output_multi", "recovered_output"), "recovered.000"

# Sentences in the columns `notes` of the boundary report and `reason` of split candidates.
NOTES = {
    "ONE_SIDE": "one side has no valid complete ensembles",
    "EXACT_OVERLAP": "all ensembles in the smaller side duplicate by full-record SHA256",
    "PARTIAL_OVERLAP": "%d exact duplicate complete ensembles overlap",
    "CONFLICT": "%d RTC-identical but hash-different valid records overlap",
    "CONFIGURATION_CHANGE": "fixed leader fingerprint changed across the boundary",
    "CLEAN_CONTIGUOUS": "timestamps join at the observed nominal cadence",
    "GAP": "elapsed time exceeds the observed nominal cadence",
    "CLEAN_WITH_COUNTER_RESET": "counter transition classified as ",
    "TRUNCATED_PREVIOUS_FILE": "previous file ends with a truncated candidate",
    "TRUNCATED_NEXT_FILE": "next file begins with a truncated candidate",
    "SAFE_SPLIT_RECONSTRUCTION": "cross-file split reconstruction validated with the original stored checksum",
    "UNRECOVERABLE_FRAGMENT": "boundary damage remains after conservative split testing",
    "AMBIGUOUS": "boundary does not fit a stronger structural classification",
}
SPLIT_OUTSIDE = "required continuation bytes are not confined to the next file's leading fragment region"
SPLIT_LATE = "candidate RTC is not plausible relative to neighboring complete ensembles"
SPLIT_OTHER_LEADER = "candidate fixed leader does not match neighboring complete ensembles"
SPLIT_SAFE = "declared length, offsets, IDs, chronology, and original stored checksum all validate"
# Sentences in the manifest's list of conflicts.
NATIVE_CONFLICT = "conflicting valid overlap at RTC %s: %s offset %d differs from earlier accepted record(s)"
REBUILT_CONFLICT = "conflicting reconstructed overlap at RTC %s: %s offset %d + %s prefix differs from earlier accepted record(s)"
