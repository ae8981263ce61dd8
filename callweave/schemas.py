"""Declared schemas of every input and stored table; nothing is inferred."""

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    """Schema from `name type, ...` with the plain types used here (no session needed)."""
    plain = {
        "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
        "date": T.DateType(), "timestamp": T.TimestampType(), "vector": T.ArrayType(T.FloatType()),
        "strings": T.ArrayType(T.StringType()),
    }
    fields = [f.split() for f in spec.split(",")]
    return T.StructType([T.StructField(n, plain[t]) for n, t in fields])


TRANSCRIPTS = _struct(
    "companyid string, companyname string, transcriptid string, componenttext string, componentorder int, "
    "mostimportantdateutc string, speakertypename string"
)
SENTIMENT = _struct(
    "permno bigint, edate string, sentiment double, theme_id string, theme_name string, firm_name string"
)
SENTIMENT_REQUIRED = ["permno", "edate", "sentiment"]

_SENTENCE = _struct("text string, speaker string, transcript_date string")
_CONTRIBUTION = T.StructType(
    _struct(
        "firm_id string, firm_name string, permno bigint, cluster_id int, earnings_call_date string"
    ).fields
    + [T.StructField("sentences", T.ArrayType(_SENTENCE))]
)
THEMES_DOCUMENT = T.StructType(
    [
        T.StructField(
            "themes",
            T.ArrayType(
                T.StructType(
                    _struct("theme_id string, theme_name string").fields
                    + [T.StructField("firm_contributions", T.ArrayType(_CONTRIBUTION))]
                )
            ),
        )
    ]
)

_TOPIC = _struct(
    "topic_id int, representation string, summary string, keywords strings, size int, sentence_ids strings"
)
FIRM_TOPICS = T.StructType(
    _struct("firm_id string, firm_name string, n_topics int").fields
    + [
        T.StructField("topics", T.ArrayType(_TOPIC)),
        T.StructField("outlier_sentence_ids", T.ArrayType(T.StringType())),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)

FIRMS = _struct(
    "id bigint, company_id string, ticker string, name string, quarter string, earnings_call_date date, "
    "processed_at timestamp"
)
SENTENCES = _struct(
    "id bigint, firm_id bigint, sentence_id string, raw_text string, cleaned_text string, position bigint, "
    "speaker_type string, topic_id bigint, probability double, embedding vector"
)
TOPICS = _struct(
    "id bigint, firm_id bigint, local_topic_id int, representation string, summary string, keywords strings, "
    "n_sentences bigint, embedding vector"
)
THEMES = _struct(
    "id bigint, name string, description string, n_topics bigint, n_firms bigint, embedding vector, "
    "created_at timestamp"
)
TOPIC_THEMES = _struct("topic_id bigint, theme_id bigint")
ENTITIES = _struct("id bigint, sentence_id bigint, entity_type string, value string, confidence double")
PROCESSED = _struct("company_id string, batch_id string, processed_at timestamp")

STORE = {
    "firms": FIRMS,
    "sentences": SENTENCES,
    "topics": TOPICS,
    "themes": THEMES,
    "topic_themes": TOPIC_THEMES,
    "extracted_entities": ENTITIES,
    "processed_firms": PROCESSED,
}

MARKET = {
    "dsf": _struct(
        "permno bigint, date date, prc double, ret double, shrout double, vol double, cfacpr double, cfacshr double"
    ),
    "dsi": _struct("date date"),
    "factors_daily": _struct("date date, mktrf double, rf double, smb double, hml double, umd double"),
    "dsedelist": _struct("permno bigint, dlstdt date, dlret double"),
    "msf": _struct("permno bigint, cusip string, date date, prc double, ret double, shrout double"),
    "fundq": _struct(
        "gvkey string, tic string, datadate date, datacqtr string, rdq date, fyearq int, fqtr int, fyr int, "
        "epsfxq double, ibq double, atq double, dlttq double, lctq double, teqq double, capxy double, "
        "cheq double, ppentq double, xrdq double, datafmt string, consol string, indfmt string"
    ),
    "funda": _struct(
        "gvkey string, datadate date, sale double, emp double, datafmt string, consol string, indfmt string"
    ),
    "ccmxpf_linktable": _struct(
        "gvkey string, lpermno bigint, linkdt date, linkenddt date, linktype string, linkprim string"
    ),
    "stocknames": _struct("permno bigint, ticker string, comnam string, namedt date, nameendt date"),
    "ibcrsphist": _struct("permno bigint, ticker string, sdate date, edate date"),
    "statsum_epsus": _struct(
        "ticker string, fpedats date, statpers date, numest int, meanest double, medest double, actual double, "
        "measure string, fiscalp string"
    ),
}
