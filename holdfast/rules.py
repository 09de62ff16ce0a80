"""Business constants of the retention domain, kept apart from the logic."""

# --- fixed values -----------------------------------------------------------

# Counter-offer for each competitor.
COUNTER_OFFERS = {
    "COMP-01": "OFF-01",
    "COMP-02": "OFF-03",
    "COMP-03": "OFF-01",
    "COMP-04": "OFF-04",
    "COMP-05": "OFF-01",
    "COMP-06": "OFF-01",
}

# Offer shown for a call topic when no competitor was mentioned.
# The keys are also the label list for topic labelling, in tie-break order.
TOPIC_OFFERS = {
    "Competitor Price Offer": "OFF-01",
    "Rate Increase Concern": "OFF-03",
    "Billing Dispute": "OFF-06",
    "Slow Speed / Performance": "OFF-04",
    "Outage / Reliability": "OFF-04",
    "Promo / Contract Expiration": "OFF-03",
    "Moving / Relocation": "OFF-05",
    "TV Value / Cord-Cutting": "OFF-07",
    "Mobile / Bundle Interest": "OFF-02",
    "Loyalty / Feels Undervalued": "OFF-05",
}

# Offer by customer profile, when the competitor gives none.
INTERNET_ONLY_OFFER = "OFF-01"
NO_MOBILE_OFFER = "OFF-02"
MONTH_TO_MONTH_OFFER = "OFF-03"
DEFAULT_OFFER = "OFF-05"

# Topics that signal the wish to disconnect.
DISCONNECT_TOPICS = ("Competitor Price Offer", "Moving / Relocation", "TV Value / Cord-Cutting")

# Service events that count as quality problems.
QUALITY_EVENTS = ("Outage", "Slow Speed")

# Churn rates are normalised to this customer base.
CHURN_BASE = 51600.0
MENTION_WINDOW_ROWS = 7
CHURN_WINDOW_ROWS = 30

# Score calibration.
CRITICAL_SHARE = 6375 / 50000
CRITICAL_CUTOFF = 0.55
CRITICAL_SPAN = 0.30
SCORE_FLOOR = 0.02
TIER_CUTOFFS = (("Critical", 0.55), ("High", 0.40), ("Medium", 0.25))
LOWEST_TIER = "Low"

# Agent tiers in presentation order; unknown tiers come last.
AGENT_TIERS = ("Top Performer", "On Target", "Needs Coaching", "At Risk")
UNKNOWN_TIER_ORDER = 9
COACHING_TIERS = ("Needs Coaching", "At Risk")

# Case note sentiment: the first matching class wins; matching is by substring.
SENTIMENT_PATTERNS = {
    "negative": "cancel|switch|threaten|port out|leave|walk|disconnect",
    "at_risk": "loyal|considering|open to|match|promo",
}
DEFAULT_SENTIMENT = "neutral"

# Note search.
SEARCH_TERMS = ("cancel", "switch", "pricing", "outage")
SEARCH_LEG_SIZE = 15
RRF_OFFSET = 60

# Conversations.
HISTORY_TURNS = 8
TITLE_LENGTH = 60
TITLE_STORE_LENGTH = 120
# A reply that is nothing but the name of the assistant it was passed to.
ROUTING_MARKER = r"(?s)^\s*<name>.*</name>\s*$"
NO_ANSWER = "I wasn't able to generate a response. Please try again."

# Domains of the operational tables.
CASE_STATUSES = ("Open", "In Progress", "Saved", "Churned")
OPEN_STATUSES = ("Open", "In Progress")
CASE_PRIORITIES = ("Low", "Medium", "High", "Critical")
APPROVAL_STATUSES = ("proposed", "approved", "corrected", "rejected")

# Boosted-tree settings.
TREE_SETTINGS = {"maxIter": 200, "maxDepth": 4, "stepSize": 0.08, "subsamplingRate": 0.8, "seed": 42}
TRAIN_SHARE = 0.75

# --- derived ------------------------------------------------------------------

TOPICS = tuple(TOPIC_OFFERS)

# General vocabulary of each topic; a text gets the topic with most hits.
TOPIC_PATTERNS = {
    "Competitor Price Offer": (r"\bcompetitors?\b", r"\bbetter offers?\b", r"\boffering\b", r"\bcheaper\b", r"\bdeals?\b", r"\bquoted?\b"),
    "Rate Increase Concern": (r"\bincreas", r"\b(price|rate)s? (hike|rise|rose|went)", r"\bmore expensive\b", r"\bhigher\b"),
    "Billing Dispute": (r"\bdisput", r"\bfees?\b", r"\bcharg(e|ed|es|ing)\b", r"\boverbill", r"\brefund", r"\binvoice"),
    "Slow Speed / Performance": (r"\bslow(er|ly)?\b", r"\bspeeds?\b", r"\blag(s|gy|ging)?\b", r"\bbuffer", r"\blatency\b"),
    "Outage / Reliability": (r"\boutages?\b", r"\bdisconnect", r"\bunreliable\b", r"\binterrupt", r"\b(is|was|went) down\b"),
    "Promo / Contract Expiration": (r"\bcontracts?\b", r"\bexpir", r"\bpromo(tion)?s?\b", r"\brenew"),
    "Moving / Relocation": (r"\bmov(e|ed|es|ing)\b", r"\brelocat", r"\baddress\b", r"\bapartment\b"),
    "TV Value / Cord-Cutting": (r"\btv\b", r"\btelevision\b", r"\bcable\b", r"\bchannels?\b", r"\bstreaming\b"),
    "Mobile / Bundle Interest": (r"\bmobile\b", r"\bbundl", r"\bwireless\b", r"\bcell ?phone"),
    "Loyalty / Feels Undervalued": (r"\bloyal", r"\bundervalued\b", r"\bappreciat", r"\bnew customers?\b", r"\blong[- ]?time\b"),
}
