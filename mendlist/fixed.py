"""Vocabularies, lookup tables, defaults and record formats.

These must hold exactly these values for results to be right, so they are kept
together here as plain text and used everywhere else by name.
"""

# Sentiment classes in class-index order, and aspect sources.
SENTIMENTS = ("negative", "neutral", "positive")
ASPECT_SOURCES = ("finetuned", "llm_fallback")

# The label vocabulary, alphabetical (label index = position).
LABELS = (
    "aesthetics",
    "compatibility",
    "cost",
    "effectiveness",
    "efficiency",
    "enjoyability",
    "general",
    "learnability",
    "reliability",
    "safety",
    "security",
    "usability",
)

# The feature taxonomy seed (feature_key, display_name, description).
TAXONOMY = (
    ("usability", "Usability", "Ease of use and user interface."),
    ("effectiveness", "Effectiveness", "How well the application achieves its goals."),
    ("general", "General", "General feedback and comments."),
    ("safety", "Safety", "Physical safety or mental well-being related."),
    ("learnability", "Learnability", "Ease of learning the application."),
    ("cost", "Cost", "Pricing, subscriptions, and value for money."),
    ("efficiency", "Efficiency", "Performance, speed, and resource usage."),
    ("compatibility", "Compatibility", "Device and OS compatibility."),
    ("security", "Security", "Data security and privacy concerns."),
    ("aesthetics", "Aesthetics", "Visual design and look-and-feel."),
    ("reliability", "Reliability", "Bugs, crashes, and stability issues."),
    ("enjoyability", "Enjoyability", "Fun, engaging, and pleasant to use."),
)

# Source category -> feature key; None means deliberately ignored.
CATEGORY_FEATURES = {
    "login": "login_auth",
    "authentication": "login_auth",
    "sync": "sync_speed",
    "synchronization": "sync_speed",
    "crash": "crashes_stability",
    "crashes": "crashes_stability",
    "stability": "crashes_stability",
    "bug": "crashes_stability",
    "bugs": "crashes_stability",
    "reliability": "crashes_stability",
    "performance": "performance_speed",
    "speed": "performance_speed",
    "efficiency": "performance_speed",
    "ui": "ui_ux_design",
    "ux": "ui_ux_design",
    "design": "ui_ux_design",
    "layout": "ui_ux_design",
    "usability": "ui_ux_design",
    "aesthetics": "ui_ux_design",
    "responsiveness": "ui_responsiveness",
    "effectiveness": "ui_responsiveness",
    "offline": "offline_mode",
    "notification": "notifications",
    "notifications": "notifications",
    "billing": "billing_subscription",
    "subscription": "billing_subscription",
    "price": "billing_subscription",
    "cost": "billing_subscription",
    "search": "search",
    "support": "customer_support",
    "help": "customer_support",
    "onboarding": "onboarding",
    "tutorial": "onboarding",
    "learnability": "onboarding",
    "privacy": "data_privacy",
    "permissions": "data_privacy",
    "security": "data_privacy",
    "safety": "data_privacy",
    "battery": "battery_usage",
    "compatibility": "compatibility",
    "device": "compatibility",
    "update": "updates",
    "updates": "updates",
    "ads": "ads_monetization",
    "advertisement": "ads_monetization",
    "advertisements": "ads_monetization",
    "monetization": "ads_monetization",
    "gameplay": "gameplay_mechanics",
    "mechanics": "gameplay_mechanics",
    "enjoyability": "gameplay_mechanics",
    "social": "social_features",
    "sharing": "social_features",
    "general": None,
    "other": None,
    "n/a": None,
    "na": None,
}

# Keyword rules (feature, trigger substrings, sentiment, confidence).
# A text holding UPLIFT_WORD turns the ui_ux rule's sentiment positive.
KEYWORD_RULES = (
    ("reliability", ("crash", "bug"), "negative", 0.95),
    ("ui_ux", ("ui", "design", "beautiful"), "neutral", 0.88),
    ("pricing", ("price", "expensive", "subscription"), "negative", 0.92),
    ("notifications", ("notification", "late"), "negative", 0.85),
)
UPLIFT_WORD = "beautiful"
NO_KEYWORD = ("general", "neutral", 0.5)

# Priority tiers (tier, least negatives, least negative share).
TIERS = (
    ("Critical", 5, 0.5),
    ("High", 3, 0.3),
    ("Medium", 1, 0.0),
)
LOWEST_TIER = "Low"

# Scoring, gating, weighting and paging defaults.
HALF_LIFE_DAYS = 90
CATEGORY_GATE = 0.65
SENTIMENT_GATE = 0.50
DECISION_THRESHOLD = 0.5
POS_WEIGHT_CAP = 15.0
CLASS_WEIGHT_CAP = 10.0
WEIGHT_EPSILON = 1e-5
GATE_EPSILON = 1e-9
LOGIT_CLIP = 50.0
SWEEP = (0.1, 0.95, 0.05)  # start, stop (exclusive), step
TEST_SHARE = 0.1
VAL_SHARE = 0.1
SPLIT_SEED = 42
PAGE_DEFAULT = 50
PAGE_MAX = 200
TOP_FEATURES = 10
INFERENCE_LIMIT = 2500

# Record formats. Names of fields in stored review metadata, the
# markers that mean "no value", and the columns an annotated CSV must carry.
META_DOMAIN = "domain"
META_ANNOTATIONS = "aware_annotations"
META_REVIEW_ID = "aware_review_id"
ANNOTATED_SOURCE = "aware"
NO_VALUE = ("N/A", "NA")
CSV_COLUMNS = ("domain", "app", "sentence", "category", "term", "sentiment", "rating")
CSV_OPTIONAL = ("review_id", "from", "to")
NEUTRAL_SPELLINGS = ("n/a", "na", "none")
STATUS_LABELED = "labeled"

# Dashboard sentences.
NO_ASPECTS_TEXT = "No aspects detected. Please provide more reviews."
COMPLAINT_TEXT = "• **%s** is the most complained-about feature (%d negative mentions)."
NO_COMPLAINT_TEXT = "• No major negative complaints detected."
PRAISE_TEXT = "• Users highly appreciate **%s** (%d positive mentions)."
FIX_TEXT = "Prioritize fixing issues related to **%s** before introducing new features."
NO_FIX_TEXT = "Maintain current stability and monitor for new issues."
INSIGHTS_HEADING = "### Top Insights\n"
RECOMMENDATION_HEADING = "\n\n### Recommendation\n"
