"""Word lists, phrases and patterns that results depend on."""

GROUNDING_STOPWORDS = (
    "a an the and or but of to in on for with is are was were be been by as at from it this that according provided material based "
    "following key about you your would should could will can not no any please answer question source"
).split()

GAIN_STOPWORDS = (
    "a an the and or but of to in on for with is are was were be been by as at from it this that these those i you he she we they me him "
    "her us them according provided material based following key about your would should could will can not no any please answer question "
    "source have has had do does did being"
).split()

PREFERENCE_STOPWORDS = (
    "a an the and or but of to in on for with is are was were be been by as at from it this that these those i you he she we they me him "
    "her us them not no any please answer question source have has had do does did will would could should can may might shall"
).split()

FRAMING_WORDS = (
    "the information material text document source context states mentions indicates says provides notes following key points above based "
    "provided according per as that this these those it and but or of in on for with is are was were a an"
).split()

METALINGUISTIC_WORDS = (
    "answer question what meaning asks ask asked about refers refer regarding concerning itself statement phrase word words sentence described"
).split()

COMPARISON_MARKERS = [
    " but ", " while ", " whereas ", " however ", " compared ", " unlike ", " greater ", " less ", " better ", " worse ", " faster ", " slower ",
    " higher ", " lower ", " more ", " fewer ", " superior ", " inferior ", " difference ", "than", "advantage", "disadvantage", "pros", "cons",
]

BOILERPLATE_PATTERNS = [
    r"according to the provided (material|text|document|source)",
    r"based on the (provided )?(information|context|text|document|source)",
    r"as per the (provided )?(information|text|document)",
    r"the (provided )?(material|text|document|source|context|information) (states|mentions|indicates|says|provides|notes)",
    r"in the (provided )?(material|text|document|source|context)",
]

DISCLAIMER_PATTERNS = [
    r"^i(?:'m| am) (?:sorry|unable|not able|not equipped|not designed)",
    r"^as an ai (?:assistant|language model)",
    r"^i cannot (?:answer|provide|help|respond)",
    r"^(?:i'm )?not (?:sure|certain|able)",
]

CHOSEN_BOILERPLATE_PATTERNS = [
    r"^according to the provided (material|text|document|source)",
    r"^based on the (provided )?(information|context|text|document|source)",
    r"^i(?:'m| am) (?:sorry|unable|not able)",
]

INJECTION_PATTERNS = [
    r"ignore (all )?(prior|previous|above) (instructions?|rules)",
    r"disregard (all )?(prior|previous) instructions",
    r"you are now",
    r"system\s*:\s*",
    r"<\|im_start\|>",
]

ANSWER_REFUSALS = ["cannot answer", "not available", "cannot determine", "unable to"]
ARTIFACT_REFUSALS = ["cannot answer", "not available", "cannot determine"]
REFUSAL_PATTERN = r"(i can'?t|i cannot|cannot help|i'?m (sorry )?not able|i don'?t (have|know)|cannot provide)"
FORMAT_MARKER_PATTERN = r"(^\s*(#|\*|-|\d\.)\s)"

GAIN_SEVERITY = {
    "heading_echo": 0.0,
    "prompt_echo": 0.0,
    "boilerplate_only": 0.0,
    "high_repetition": 0.1,
    "low_unique_token_ratio": 0.2,
    "insufficient_content_for_explanation": 0.0,
    "missing_comparison_dimension": 0.3,
    "summary_not_condensed": 0.5,
    "disclaimer_only": 0.0,
    "empty_answer": 0.0,
    "circular_reasoning": 0.0,
}

INTAKE_LICENSES = {
    "unknown": ["unknown", "", "unlicensed", "proprietary-not-declared"],
    "allowed": ["mit", "apache-2.0", "apache 2.0", "bsd", "bsd-3-clause", "unlicense"],
    "blocked": ["proprietary", "closed", "all rights reserved", "confidential"],
}

REPORT_LICENSES = {
    "blocked": ["cc-by-nd", "cc-by-nc-nd", "all rights reserved", "copyright"],
    "allowed": [
        "cc0", "cc-by", "cc-by-sa", "cc-by-4.0", "cc-by-sa-4.0", "cc0-1.0", "mit", "apache-2.0", "bsd-3-clause", "bsd-2-clause", "unlicense",
        "public domain", "open government", "odc-by", "odc-odbl",
    ],
    "review": ["cc-by-nc", "cc-by-nc-sa", "cc-by-nc-nd", "gfdl", "lgpl", "gpl-3.0", "gpl-2.0", "ms-pl", "proprietary", "custom", "unknown"],
}

NEGATION_WORDS = (
    "not no never neither nor none nobody nothing nowhere cannot can't don't doesn't didn't won't wouldn't couldn't shouldn't isn't aren't "
    "wasn't weren't hasn't haven't hadn't prohibited forbidden disallowed banned without unable except excluding absence"
).split()

DOUBLE_NEGATIONS = ["not uncommon", "not unknown", "not impossible", "not unlike", "not un", "not in", "not lacking", "not without"]
OPENING_NEGATIONS = ["not", "no", "never", "neither", "nor"]

#: Marker and direction, in the order in which they are tried.
CAUSAL_MARKERS = [
    ("causes", "causes"), ("cause", "causes"), ("caused", "causes"), ("result in", "causes"), ("results in", "causes"), ("resulted in", "causes"),
    ("leads to", "causes"), ("lead to", "causes"), ("led to", "causes"), ("triggers", "causes"), ("triggered", "causes"),
    ("is caused by", "caused_by"), ("are caused by", "caused_by"), ("was caused by", "caused_by"), ("results from", "caused_by"),
    ("result from", "caused_by"), ("resulted from", "caused_by"), ("depends on", "caused_by"), ("depended on", "caused_by"),
]

#: Unit words, canonical name, kind, multiplier to the kind's base unit.
UNITS = [
    ("seconds second sec secs", "seconds", "time", 1.0),
    ("minutes minute min mins", "minutes", "time", 60.0),
    ("hours hour hr hrs", "hours", "time", 3600.0),
    ("days day", "days", "time", 86400.0),
    ("weeks week", "weeks", "time", 604800.0),
    ("months month", "months", "time", 2592000.0),
    ("ms milliseconds millisecond", "milliseconds", "time", 0.001),
    ("b bytes byte", "bytes", "data", 1.0),
    ("kb kilobytes kilobyte", "kilobytes", "data", 1000.0),
    ("mb megabytes megabyte", "megabytes", "data", 1e6),
    ("gb gigabytes gigabyte", "gigabytes", "data", 1e9),
    ("meters metres m", "meters", "distance", 1.0),
    ("kilometers kilometres km", "kilometers", "distance", 1000.0),
    ("centimeters centimeter centimetres centimetre cm", "centimeters", "distance", 0.01),
    ("millimeters millimeter millimetres millimetre mm", "millimeters", "distance", 0.001),
    ("liters liter litres litre", "liters", "volume", 1.0),
    ("milliliters milliliter millilitres millilitre ml", "milliliters", "volume", 0.001),
    ("kilograms kilogram kg", "kilograms", "mass", 1.0),
    ("grams gram", "grams", "mass", 0.001),
    ("usd $", "usd", "currency", 1.0),
    ("eur €", "eur", "currency", 1.0),
    ("gbp £", "gbp", "currency", 1.0),
]

DISCOURSE_WORDS = (
    "a according additionally all also an any as at above after before because below both but by during each every finally first following "
    "for from further furthermore given hence here he her hers him his how i if in into it its let lets may might moreover next no not note of "
    "on once one only or other our out over per second she should since so some such than that the their them then there these they third "
    "this those thus to therefore under until up upon us using we were what when where whether which while who whom whose why will with within "
    "without you your"
).split()

EXCHANGE_NON_ANCHORS = (
    "the a an to by with from for into onto over under after before during is are was were be been being its their his her each every and or"
).split()

NUMBER_CONTEXT_STOPWORDS = "with from that this these those what which there their than they have been were into over such each also".split()

#: From each job state, the states that may follow.
JOB_TRANSITIONS = {
    "queued": ["leased", "cancelled", "failed"],
    "leased": ["running", "queued", "cancelled", "failed"],
    "running": ["pausing", "retry_wait", "succeeded", "failed", "cancelling"],
    "pausing": ["paused", "failed", "cancelling"],
    "paused": ["queued", "failed", "cancelled"],
    "retry_wait": ["queued", "failed", "cancelled"],
    "cancelling": ["cancelled", "failed"],
    "succeeded": [],
    "failed": ["queued"],
    "cancelled": [],
}

COMPARISON_PHRASES = [" greater than ", " larger than ", " bigger than ", " less than ", " smaller than ", " higher than ", " lower than ", " exceeds ", " exceed "]
COMPARISON_WORDS = ["greater", "larger", "less", "smaller", "higher", "lower", "exceeds", "above", "below", "more than", "less than"]
CLAIM_CAUSES = ["causes", "cause", "caused", "results in", "leads to", "triggers"]
BE_WORDS = [" is ", " are ", " was ", " were ", " has ", " have ", " had "]

SPAN_PRECISIONS = ["exact_bbox", "exact_page", "page_range", "section", "chunk", "unknown"]
