"""Values that fix the meaning of the data model."""

# Columns kept from a raw feed record, in feed order.
FEED_COLUMNS = [
    "DATE",
    "SourceCommonName",
    "DocumentIdentifier",
    "Themes",
    "Organizations",
    "V2Tone",
]

# The seven tone metrics, in the order the feed lists them.
TONE_COLUMNS = [
    "Tone",
    "PositiveTone",
    "NegativeTone",
    "Polarity",
    "ActivityDensity",
    "SelfDensity",
    "WordCount",
]

# Theme token that sets each article flag.
FLAG_TOKENS = {"E": "ENV", "S": "UNGP", "G": "ECON"}

# Columns of the flat article export.
EXPORT_COLUMNS = [
    "DATE",
    "SourceCommonName",
    "URL",
    "E",
    "S",
    "G",
    "Organization",
    "Tone",
    "PositiveTone",
    "NegativeTone",
    "Polarity",
    "ActivityDensity",
    "SelfDensity",
    "WordCount",
]

# Columns of the article listing.
LISTING_COLUMNS = [
    "DATE",
    "SourceCommonName",
    "URL",
    "Tone",
    "Polarity",
    "ActivityDensity",
    "SelfDensity",
]

# Columns of the positive-against-negative scatter.
SCATTER_COLUMNS = [
    "NegativeTone",
    "PositiveTone",
    "WordCount",
    "Polarity",
    "DATE",
    "SourceCommonName",
]

# Share-class words and letters removed from holding names.
SHARE_CLASS_WORDS = ["CLASS", "SERIES", "REIT", "SHS"]
SHARE_CLASS_LETTERS = ["A", "B", "C", "I"]

# Legal endings dropped when alternative names are derived, and
# how many of them one name may carry.
LEGAL_ENDINGS = [
    "inc",
    "corp",
    "plc",
    "reit",
    "co",
    "cor",
    "group",
    "company",
    "trust",
    "energy",
    "international",
    "of america",
    "pharmaceuticals",
    "clas",
    "in",
    "nv",
    "sa",
    "re",
]
ENDING_ROUNDS = 3

# Location type codes of the feed.
LOCATION_TYPES = {
    "1": "COUNTRY",
    "2": "USSTATE",
    "3": "USCITY",
    "4": "WORLDCITY",
    "5": "WORLDSTATE",
}

# Display names of the segments.
SEGMENT_LABELS = {
    "T": "Overall",
    "E": "Environment",
    "S": "Social",
    "G": "Governance",
}

# File layout of a stored bundle, and the named periods.
BUNDLE_FILES = {
    "conn": "connections.csv",
    "data": "data_as_csv.csv",
    "embed": "pca_embeddings.csv",
    "overall_score": "ESG/overall_daily_esg_scores.csv",
    "E_score": "ESG/daily_E_score.csv",
    "S_score": "ESG/daily_S_score.csv",
    "G_score": "ESG/daily_G_score.csv",
    "ESG": "ESG/average_esg_scores.csv",
}
BUNDLE_PERIODS = {
    "ten_days": ("2020-12-01", "2020-12-10"),
    "one_month": ("2020-11-11", "2020-12-12"),
}

# Sizes the reports use unless told otherwise.
UNIVERSE_SIZE = 300
STORED_NEIGHBORS = 25
SHOWN_NEIGHBORS = 8
SCORE_SCALE = 10000
HOLDINGS_PREAMBLE_LINES = 9
INDUSTRY_LABEL = "Industry Average"
