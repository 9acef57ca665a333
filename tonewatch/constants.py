"""Values that results depend on, kept in one place and used by every module."""

# ---------------------------------------------------------------------------
# Label names and codes, cleaning patterns, stop words, thresholds.
# ---------------------------------------------------------------------------

LABEL_CODES = {"Negative": 0, "Positive": 1, "Neutral": 2, "Irrelevant": 3}
UNKNOWN_LABEL = "Unknown"
EXCLUDED_CLASS = 3

# Every code point from U+24C2 upwards, plus four single symbols.  The class is
# wide on purpose: it also takes CJK, Hangul and all astral characters.
EMOJI_PATTERN = r"[\x{200D}\x{231A}\x{23CF}\x{23E9}\x{24C2}-\x{10FFFF}]+"
URL_PATTERN = r"https?://\S+|www\.\S+|\.com\S+|youtu\.be/\S+"
URL_MARKERS = ("http", "www.", ".com", "youtu.be/")
MENTION_PATTERN = r"[@#]\w+"
UNKNOWN_TOKEN = "<unk>"

# The usual English stop-word list, contractions and their fragments included.
ENGLISH_STOP_WORDS = tuple("""
a about above after again against ain all am an and any are aren aren't as at
be because been before being below between both but by can couldn couldn't d
did didn didn't do does doesn doesn't doing don don't down during each few for
from further had hadn hadn't has hasn hasn't have haven haven't having he he'd
he'll he's her here hers herself him himself his how i i'd i'll i'm i've if in
into is isn isn't it it'd it'll it's its itself just ll m ma me mightn mightn't
more most mustn mustn't my myself needn needn't no nor not now o of off on once
only or other our ours ourselves out over own re s same shan shan't she she'd
she'll she's should should've shouldn shouldn't so some such t than that
that'll the their theirs them themselves then there these they they'd they'll
they're they've this those through to too under until up ve very was wasn
wasn't we we'd we'll we're we've were weren weren't what when where which while
who whom why will with won won't wouldn wouldn't y you you'd you'll you're
you've your yours yourself yourselves
""".split())

# Labelled sentences used to smoke-test a freshly trained model; any short texts of each class will do.
SMOKE_SAMPLES = (
    ("Setup took two minutes and it has worked every day since.", 1),
    ("The lamp is grey and 40 cm tall.", 2),
    ("Third replacement in a month, and this one hums as well.", 0),
    ("Quieter than I hoped, I would choose it again.", 1),
    ("Nobody answers the phone or the mails.", 0),
    ("It comes with a cable and a manual.", 2),
)

OBJECT_STORE_SCHEMES = ("s3", "s3a", "s3n")
NO_VERSION = "N/A"

SPLIT_SEED = 42
TRAIN_RATIO = 0.8
ACCURACY_GATE = 0.8
PSI_THRESHOLD = 0.1
TEXT_DRIFT_THRESHOLD = 0.5
DRIFT_CONFIDENCE = 0.99
QUALITY_TOLERANCE = 0.1
DRIFT_SHARE = 0.5
PSI_ZERO_SHARE = 0.0001
MAX_DISCRETE_VALUES = 20

# Sizes and grids of the classifiers.
HASHING_FEATURES = 10000
LOGREG_MAX_ITER = 20
GRID_NUM_FEATURES = (1000, 5000, 10000)
GRID_VOCAB_SIZE = (5000, 10000)
GRID_REG_PARAM = (0.0, 0.01, 0.1)

# Names in alerts and runs.
ALERT_TYPES = {
    "data_drift": "Data Drift Detected",
    "model_drift": "Model Drift Detected",
    "dataset_summary": "Dataset Summary Issue",
}
RUN_NAME_FORMAT = "yyyy-MM-dd_HH-mm-ss"

# How the network is trained and what its grid tries.
NETWORK_EPOCHS = 10
NETWORK_RATE = 0.003
NETWORK_BATCH = 8
GRID_NETWORK_RATE = (0.003, 0.01)
GRID_NETWORK_BATCH = (8,)
GRID_NETWORK_EPOCHS = 5
