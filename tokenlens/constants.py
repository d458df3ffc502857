"""Fixed values that must equal the original tool's for results to agree.

They are stated here once, plainly, in their natural order.
"""

# --- fixed values: corpus geometry -------------------------------------------------------
STEPS_PER_CHECKPOINT = 1000          # training steps per macro step / shard
SEQUENCES_PER_STEP = 1024            # sequences per training step (batch size)
SAMPLES_PER_SHARD = STEPS_PER_CHECKPOINT * SEQUENCES_PER_STEP   # 1,024,000
SEQ_LENGTH = 2049                    # tokens per sample
N_SHARDS = 95                        # macro steps
SEPARATOR_ID = 65535                 # document separator in the separated stream
MAX_TOKEN_ID = 65535                 # uint16 token ids
TOKEN_BYTES = 2                      # bytes per uint16 token in the separated stream
SHARD_FILE_PATTERN = r"train-([0-9]+)"   # macro-step file names: train-001000 .. train-095000

# --- fixed values: checkpoints and epochs --------------------------------------------------
MODEL_VARIANTS = ["70m", "160m", "410m", "1.4b", "2.8b", "6.9b", "12b"]
REVISION_MIN = 0
REVISION_MAX = 143000
REVISION_STEP = 1000
FIRST_STEP_OF_SECOND_EPOCH = 95000
BATCH_SIZE = 1024
FIRST_REPEATED_SEQ_IDX = FIRST_STEP_OF_SECOND_EPOCH * BATCH_SIZE   # 97,280,000
CHECKPOINT_INTERVAL = 1000

# fact grid: steps 40,000 <= step < 96,000 by 1,000, scored with this variant
FACT_STEP_START = 40000
FACT_STEP_END = 96000
FACT_STEP_BY = 1000
FACT_VARIANT = "6.9b"

# --- fixed values: search defaults ---------------------------------------------------------
DEFAULT_CONTEXT_LEN = 50             # tokens on each side of a hit
SHARD_FILE_PREFIX = "tokenized."     # index file names, sorted lexicographically to number documents
HEADROOM = 1.15                      # y-axis headroom over the tallest stacked bar
