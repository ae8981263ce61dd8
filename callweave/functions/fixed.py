"""Results are only right when these equal the published ones."""

# words of call talk without topic signal, dropped along with the common stop words
CALL_STOPWORDS = ["yes", "thank", "thanks", "question", "questions", "afternoon", "operator", "welcome"]

# risk models of the event study and the factors each regresses on
MODEL_FACTORS = {
    "madj": [],
    "m": ["mktrf"],
    "ff": ["smb", "hml", "mktrf"],
    "ffm": ["smb", "hml", "mktrf", "umd"],
}

# regressors of the theme regression, in order
COVARIATES = [
    "Return_on_Assets",
    "Book_Leverage",
    "Capital_Expenditures",
    "Research_and_Development",
    "Sales_Growth",
    "Firm_Size",
    "Cash",
    "Asset_Tangibility",
    "Delta_Employee_Change",
    "Stock_Volatility",
    "Stock_Return",
    "Market_to_Book",
    "Earnings_Surprise",
]

BUCKETS = ["Low", "Medium", "High"]
TERCILE_PROBS = {"q33": 0.33, "q67": 0.67}
STUDY_WINDOW = {"estwin": 100, "gap": 50, "evtwins": -10, "evtwine": 10, "minval": 70}
PORTFOLIO_DAYS = 90
PORTFOLIO_PULL_DAYS = 120
MIN_FIRMS = 2
MAX_DOMINANCE = 0.4
LINK_TYPES = ["LU", "LC"]
LINK_PRIMARY = ["P", "C"]

# caps that are part of the feature
PROMPT_SENTENCES = 50
PROMPT_SUMMARIES = 10
TOPIC_KEYWORDS = 10
LABEL_TERMS = 8
LABEL_PER_SOURCE = 3
STORED_KEYWORDS = 20
CANDIDATE_TERMS = 30

TOPIC_DEFAULTS = {
    "umap": {"n_components": 10},
    "hdbscan": {
        "min_cluster_size": 6,
        "min_samples": 2,
        "cluster_selection_method": "leaf",
    },
    "vectorizer": {"ngram_range": [1, 2], "min_df": 2},
    "representation": {"mmr_diversity": 0.3},
}
