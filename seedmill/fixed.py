"""Folder names, tokens, limits and messages the data formats rely on."""

# First path part of every seed file, and the one accepted file name.
TAXONOMY_FOLDERS = ("compositional_skills", "foundational_skills", "knowledge")
SEED_FILE_NAME = "qna.yaml"
SEED_FILE_NEAR_NAMES = ("qna.yml", "qna.yaml")

# Role markers inside prompt text.
SYSTEM_TOKEN = "<|system|>"
USER_TOKEN = "<|user|>"
ASSISTANT_TOKEN = "<|assistant|>"
END_TOKEN = "<|endoftext|>"
RESPONSE_MARKER = "\n<|assistant|>\n"

# Fixed value: the system prompt used when no architecture has one of its own.
DEFAULT_SYSTEM_PROMPT = (
    "I am an advanced AI language model designed to assist you with a wide range of tasks "
    "and provide helpful, clear, and accurate responses. My primary role is to serve as a "
    "chat assistant, engaging in natural, conversational dialogue, answering questions, "
    "generating ideas, and offering support across various topics."
)

# Default limits of the workflow.
SEED_EXAMPLES_MIN = 5
SEED_WORD_BUDGET = 2300
SCALE_FACTOR = 30
CHUNK_WORDS = 1000
CHUNK_TOKENS = 150
MAX_GENERATED_TOKENS = 4096
MAX_SEQUENCE_TOKENS = 4096
WARN_SEQUENCE_TOKENS = 2048
GENERATOR_BATCH = 8
RETRIEVER_TOP_K = 3
REDUCED_TASKS = 4
RUBRIC_MAX = 5

# Job states and job types.
RUNNING, DONE, ERRORED = "Running", "Done", "Errored"
JOB_TYPES = ("Generation", "Training")

# Documents a knowledge seed file may point to, result formats, artifact folder.
DOCUMENT_SUFFIXES = (".md", ".pdf")
RESULT_FORMATS = ("csv", "jsonl", "xlsx")
ARTIFACTS_FOLDER = "docling-artifacts"

# Fixed value: files below a folder ``session_lines=...`` hold a session in each line.
SESSION_LINES = "session_lines"

# Name patterns of dataset files and of model locations.
DATASET_NAME_PATTERN = (
    r"^(test|messages|train)_([\w\-\.]+)_(\d{4}-\d{2}-\d{2}T\d{2}_\d{2}_\d{2})"
)
S3_BUCKET_PATTERN = r"^[a-zA-Z0-9.\-_]{1,255}$"
OCI_URL_PATTERN = (
    r"^docker://([a-zA-Z0-9\-_.]+(:[0-9]+)?)(/[a-zA-Z0-9\-_.]+)+"
    r"(@[a-zA-Z0-9]+|:[a-zA-Z0-9\-_.]+)?$"
)
OWNER_MODEL_PATTERN = r"^[\w.-]+\/[\w.-]+$"

# The characters that count as blank, in code point order.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# The same characters as a pattern: a property class and four controls, which matches faster than a list.
BLANKS_PATTERN = r"(?U)[\s\x1c-\x1f]+"

# Timestamp layouts of listings and of run folders.
LISTING_TIME = "yyyy-MM-dd HH:mm:ss"
RUN_FOLDER_TIME = "yyyy-MM-dd_HHmmss"
