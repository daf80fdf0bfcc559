"""Fixed values the results depend on: prices, thresholds, word lists, status domains.

Everything in this module is data. The order of a list or a dictionary is part of
the value wherever a "first entry wins" rule reads it.
"""

# ---- pricing: base repair cost per part keyword (first matching entry wins) ----
BASE_REPAIR_COST = {
    "dent": 8000, "scratch": 3000, "crack": 12000, "puncture": 6000, "headlight": 15000,
    "head light damage": 15000, "signlight damage": 8000, "windshield": 18000,
    "window": 10000, "frame": 35000, "bumper": 12000, "hood": 20000, "door": 18000,
    "fender": 14000, "tail_light": 8000, "taillight": 8000, "mirror": 5000,
    "bonnet": 20000, "trunk": 16000, "panel": 10000, "paint": 4000, "rust": 6000,
    "glass": 12000,
}
DEFAULT_REPAIR_COST = 10000
PRICE_REDUCTION = 0.9
SEVERITY_MULTIPLIER = {
    "none": 0.0, "minor": 0.6, "semi_minor": 0.8, "moderate": 1.0,
    "semi_moderate": 1.3, "semi_severe": 1.55, "severe": 1.8,
}
EXTENT_MULTIPLIER = {"localized": 1.0, "multi-panel": 1.25, "frame-level": 1.75}
LOCATION_MULTIPLIER = {
    "front": 1.1, "rear": 1.05, "left-side": 1.0, "right-side": 1.0,
    "roof": 1.15, "underbody": 1.3, "multiple": 1.2,
}
PARTS_STEP, PARTS_CEILING, PRICED_PARTS_MAX = 0.08, 1.5, 8
LABOUR_RATE, LABOUR_MINIMUM, GST_RATE = 0.15, 450, 0.18

# ---- pricing: workshop catalogue (minor, moderate, severe) ----
WORKSHOP_CATALOG = {
    "Dent": (1500, 3500, 8500), "scratch": (500, 1800, 4000), "Crack": (1200, 3000, 7000),
    "Paint chip": (800, 2200, 5000), "Puncture": (150, 300, 800),
    "head light damage": (2000, 5000, 12000), "Windshield damage": (2500, 7000, 16500),
    "Windows": (1800, 4000, 9500), "Frame damage": (3500, 8000, 18500),
}
CATALOG_FALLBACK = 3000
CATALOG_ZERO_WORDS = ("none", "no damage", "false", "nothing", "unclear")
# severity -> (lower band index, upper band index, position between the two)
CATALOG_INTERPOLATION = {
    "semi_minor": (0, 1, 0.40), "semi_moderate": (1, 2, 0.35), "semi_severe": (1, 2, 0.70),
}

# ---- severities and statuses ----
SEVERITIES = ("none", "minor", "semi_minor", "moderate", "semi_moderate", "semi_severe", "severe")
SEVERITY_SCORE_V1 = {"none": 0, "minor": 3, "moderate": 6, "severe": 9}
SEVERITY_SCORE_V1_DEFAULT = 5
SEVERITY_SCORE_V2 = {
    "none": 0, "minor": 2, "semi_minor": 3, "moderate": 5,
    "semi_moderate": 6, "semi_severe": 8, "severe": 9,
}
TRUE_WORDS = ("true", "yes", "1", "flagged")
OFFLINE_STATUSES = (
    "draft", "pending_upload", "processing", "approved", "no_damage",
    "review_required", "system_error", "rejected", "failed_upload",
)
STATUS_LABELS = {
    "approved": "DAMAGE DETECTED", "no_damage": "NO DAMAGE DETECTED",
    "review_required": "REVIEW REQUIRED", "flagged": "REVIEW REQUIRED",
    "rejected": "FORENSIC REJECTION", "system_error": "SYSTEM ERROR",
    "pending_upload": "PROCESSING", "processing": "PROCESSING",
    "failed_upload": "SYSTEM ERROR",
}
QUEUEABLE_STATUSES = ("draft", "pending_upload", "failed_upload", "processing")
TRANSACTION_STATES = (
    "UPLOADING", "INVALID_EVIDENCE", "CONVERSION_FAILURE", "FORENSIC_ENGINE_FAILURE",
    "FORENSICS_COMPLETE", "REJECTED_FORENSICS", "INFERENCE_TIMEOUT", "INFERENCE_UNAVAILABLE",
    "INFERENCE_COMPLETE", "PERSISTENCE_FAILURE", "INFRA_FAILURE", "NO_DAMAGE",
    "APPROVED_AUTHENTIC",
)
MAX_STORAGE_BYTES = 500 * 1024 * 1024
MAX_OFFLINE_CLAIMS = 25
MAX_HISTORY_CLAIMS = 20
DEFAULT_OWNER = "local-development"

# ---- detections ----
MIN_CONFIDENCE = 0.45
MAX_DETECTIONS = 12
NO_DAMAGE = "No damages detected"
SAME_FRAME_IOU, OTHER_FRAME_IOU, CENTRE_DISTANCE = 0.35, 0.25, 0.12
REPLAY_FLAG_CONFIDENCE = 0.60

# ---- risk scoring: label pairs that plausibly occur together (symmetric) ----
PLAUSIBLE_PAIRS = (
    ("dent", "scratch"), ("bumper", "headlight"), ("bumper", "dent"), ("bumper", "scratch"),
    ("hood", "dent"), ("windshield", "crack"), ("door", "dent"), ("door", "scratch"),
    ("fender", "dent"), ("fender", "scratch"), ("bumper", "crack"), ("hood", "scratch"),
    ("tail_light", "bumper"), ("mirror", "door"), ("frame", "dent"),
)
RISK_LAYERS = (
    "Damage Consistency", "Severity vs. Cost Plausibility",
    "AI Detection Confidence", "Detection Count Analysis",
)

# ---- fingerprint matching ----
HASH_RADIUS = 12
CONSENSUS_RATE, REVERSED_RATE = 0.5, 0.6
SCENE_SIMILARITY, SCENE_SOLO_SIMILARITY = 0.90, 0.95
MOTION_TOLERANCE, MOTION_AGREEMENT = 3, 0.5
TIME_WINDOW_S, TIME_SIMILARITY = 300, 0.75
GPS_RADIUS_M, GPS_SIMILARITY = 100.0, 0.70
EARTH_RADIUS_M = 6371000.0
MATCH_RULES = (
    "legacy", "anchor_first", "anchor_last", "subset", "consensus",
    "reversed", "scene", "time_window", "gps_radius",
)

# ---- audit stages ----
STAGE_NAMES = (
    "Metadata and container integrity", "Duplicate and motion fingerprint",
    "Visual tampering and screen replay", "Face and liveness assessment",
    "Public-web reverse search",
)
STAGE_KEYS = ("stage1_exif", "stage2_phash", "stage3_ela", "stage4_deepfake", "stage5_reverse_search")
STAGE_SHORT_NAMES = (
    "Metadata and container integrity", "Duplicate and motion fingerprint",
    "Visual tampering", "Face and liveness", "Public-web reverse search",
)
STAGE_STATUSES = ("PASSED", "FAILED", "WARNING", "SKIPPED")
STAGE_DEFAULT_CODES = {
    1: "EXIF_CONTAINER_REJECTED", 2: "DUPLICATE_CLAIM_REJECTED",
    3: "VISUAL_TAMPERING_REJECTED", 4: "CLAIMANT_FACE_REQUIRED",
    5: "REVERSE_SEARCH_STOLEN_WEB_MEDIA",
}
# Codes of the single checks.
FRAMES_CODE, STATIC_CODE, SCREEN_CODE, BLOCKS_CODE = (
    "FRAME_EXTRACTION_FAILED", "STATIC_VIDEO_REJECTED", "SCREEN_RECORDING_REJECTED", "LOCALIZED_TAMPERING_REJECTED",
)

# ---- container metadata keywords (first listed hit wins) ----
EDITING_KEYWORDS = (
    "capcut", "vicut", "inshot", "kinemaster", "filmora", "videoleap", "splice", "quik",
    "magisto", "lomotif", "powerdirector", "wevideo", "vita", "meitu", "tiktok", "snapchat",
    "insta edits", "instaedits", "vn editor", "vneditor", "vn_app", "picsart", "snapseed",
    "vsco", "faceapp", "facetune", "lightroom", "pixlr", "photoshop", "gimp", "canva",
    "premiere", "adobe premiere pro", "after effects", "davinci", "resolve", "final cut",
    "finalcut", "handbrake", "vimeo", "youtube", "yt5s", "y2mate", "ssyoutube", "savefrom",
    "videvo", "gettyimages", "shutterstock", "istockphoto", "stock.adobe", "alamy",
    "dreamstime", "depositphotos", "freepik", "pexels", "pixabay", "envato", "storyblocks",
    "clipchamp", "keepvid", "snapsave", "fastfrom", "y2bit", "videodownloader",
)
GENERIC_EDIT_SIGNALS = (
    "editor", "edited", "reencod", "re-encod", "converter", "converted", "postprocess",
    "post-process", "muxed by", "handbraked", "isfromeditor", "isfromtool", "isfromedit",
    "createdwith", "created with", "madewith", "made with", "exportedby", "exported by",
    "processedby", "processed by", "filteredby", "filtered by", "rendered by", "renderedby",
)
TRANSFER_MARKERS = ("whatsapp", "wa_", "vid-wa", "img-wa", "airdrop")
TAG_VALUE_KEYWORDS = (
    "photoshop", "gimp", "canva", "lightroom", "picsart", "snapseed", "vsco", "editor",
    "paint.net", "pixlr", "adobe", "faceapp", "facetune", "inshot", "capcut", "insta edits",
    "vn", "adobe premiere pro", "premiere",
)
SOFTWARE_TAGS = ("Image Software", "EXIF Software", "ProcessingSoftware")
DATETIME_TAGS = ("EXIF DateTimeOriginal", "Image DateTime", "EXIF DateTimeDigitized")

# ---- signal thresholds ----
STATIC_FEED_THRESHOLD = 1.0
PEAK_RATIO_FLOOR, PEAK_RATIO_SPAN, PEAK_WARNING = 25.0, 75.0, 0.65
PLANAR_MIN_TRACKED, PLANAR_WARNING = 10, 0.90
REPLAY_SCORE, REPLAY_PEAK, REPLAY_PLANAR = 0.50, 0.80, 0.85
BLOCK_MIN_STD, BLOCK_MIN_GAP, BLOCK_COPY_RADIUS = 15.0, 2, 2
SPLICE_TARGET, SPLICE_NEIGHBOURS = 18, 3.0
LIVENESS_VARIANCE, LIVENESS_LOW_VARIANCE, LIVENESS_IGNORED = 12.0, 15.0, 900.0
LIVENESS_MIN_BAND, LIVENESS_MAX_LOCAL = 0.00008, 0.025
