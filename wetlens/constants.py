"""Fixed values of the imagery, the detectors and the label scheme."""

TILE = 512
STRIDE = 256
PATCH = 64
CONTEXT_OFFSET = 224
BLOCK = 32
EPSG = 3067
MIN_AREA_M2 = 500.0
INDEX_EPSILON = 1e-6
NDVI_CUT, NDWI_CUT = 0.2, 0.0
STREAM_BUFFER_M = 50.0
STREAM_LAYERS = ("virtavesialue", "tulvaalue", "virtavesikapea")
CENTRELINE_LAYER = "virtavesikapea"
VECTOR_SUFFIXES = (".gpkg", ".shp", ".geojson", ".json", ".fgb")
EXCLUDED_TYPES = ("lodge", "dam")
#: Label of a feature type; any other is 2.
LABELS = {"negative": 0, "wet_forest": 1, "beaver_flood": 1, "unknown": 1}
OTHER_LABEL = 2
#: Part of a chip's file name by label.
CHIP_TAGS = {0: "neg", 1: "dam", 2: "flood"}
#: Name of a label in reports; any other is a question mark.
CLASS_NAMES = {0: "negative", 1: "dam", 2: "flood"}
THRESHOLD = 0.5
TREES, SEED = 100, 42
TEST_SHARE = 0.2
FEW_POSITIVES = 20
NEGATIVE_ATTEMPTS = 500
#: KML colours (AABBGGRR) of line and fill.
TIER_COLOURS = {"high": ("ff00ff00", "8000ff00"), "medium": ("ff00ffff", "8000ffff"), "low": ("ff0000ff", "800000ff")}
MODEL_COLOURS = {"rf": ("ff0000ff", "800000ff"), "cnn": ("ffff0000", "80ff0000"), "both": ("ffff00ff", "80ff00ff")}
