"""Values that define results: word lists, weights and patterns.

Fixed values. They are stated here as text, in natural order, so that every operator and
every test reads them from one place; SQL texts are built from the same tables.
"""

from __future__ import annotations

DETERMINERS = "the a an this that these those its their our such said".split()

#: Nouns whose singular ends in s.
SINGULAR_IN_S = """
bias gas atlas canvas alias lens news series species means physics mathematics statistics optics
acoustics electronics mechanics dynamics kinetics robotics photonics informatics genomics proteomics
ceramics logistics diagnostics analytics semantics ethics
""".split()

IRREGULAR = {
    "analyses": "analysis", "bases": "basis", "indices": "index", "matrices": "matrix", "vertices": "vertex",
    "media": "medium", "data": "data", "criteria": "criterion", "phenomena": "phenomenon",
}

#: Words after which a full stop ends no sentence.
ABBREVIATIONS = """
e.g i.e cf vs etc al fig figs eq eqs ref refs sec secs tab tabs approx resp no nos pat pats u.s us ser inc ltd corp co
dept univ dr prof mr mrs ms jr sr vol pp ch app appl pub publ int nat proc trans j
""".split()

FUNCTION_WORDS = """
a an the of in on at to for with by from as is are was were be been being and or nor but so yet if then than that which
who whom whose this these those it its their there here when where while during after before above below into onto upon
within without between among through across over under said such any all each both more most less least other another
same
""".split()

#: (name, pattern, weight): forms that ordinary vocabulary seldom has.
ORTHOGRAPHIC = (
    ("acronym", r"^[A-Z][A-Z0-9]{1,7}(-[A-Z0-9]{1,4})?$", 2.2),
    ("camel", r"^[A-Z][a-z]+([A-Z][a-z0-9]+)+$", 2.4),
    ("versioned", r"\b(v?[0-9]+(\.[0-9]+)+|-[0-9]+[Bb]|[0-9]+[BbMm])\b", 1.8),
    ("acronym_digits", r"^[A-Za-z]{2,10}-?[0-9]{1,3}$", 1.6),
    ("proper_hyphen", r"^[A-Z][A-Za-z]+-[A-Z][A-Za-z]+$", 1.8),
    ("greek", r"^[A-Za-z]*[α-ω][A-Za-z-]*$", 0.8),
    ("formula", r"^([A-Z][a-z]?[0-9]*){2,}$", 2.0),
)

ORGANISATIONS = """
inc llc ltd gmbh corp corporation company co university universita universite institute laboratory laboratories foundation
college school department technologies holdings group ag sa nv kk plc
""".split()

UNITS = "nm um mm cm m km mg g kg ms s min h hz khz mhz ghz v mv kv a ma w kw mw j kj k c f pa kpa mpa bar psi % wt% mol ppm".split()

TYPES = "artifact method material task field dataset metric tool not_tech".split()

#: Log-odds contributions of features by type; a feature not named has weight 0.
TYPE_WEIGHTS: dict[str, dict[str, float]] = {
    "artifact": {"bias": -0.4, "head_type_match": 2.0, "exact_head_match": 0.2, "orthographic": 1.1, "kb_hit": 0.5, "kb_depth_deep": 0.8, "has_digit": 0.5, "has_upper": 0.7, "hyphenated": 0.3, "abbrev_pair": 1.0, "llm_agrees": 1.4, "head_is_tech": 0.6, "n_tokens": 0.15},
    "method": {"bias": 0.1, "head_type_match": 2.0, "exact_head_match": 0.6, "orthographic": -0.3, "kb_hit": 0.4, "kb_depth_deep": 0.4, "all_lower": 0.6, "llm_agrees": 1.4, "head_is_tech": 0.5, "n_tokens": 0.2, "ncvalue": 0.15, "suffix_ion": 0.3},
    "material": {"bias": -0.8, "head_type_match": 2.2, "exact_head_match": 0.8, "orthographic": 0.4, "has_digit": 0.3, "llm_agrees": 1.4, "head_is_tech": 0.3, "n_tokens": 0.1},
    "task": {"bias": -0.6, "head_type_match": 2.2, "exact_head_match": 1.0, "orthographic": -0.5, "all_lower": 0.4, "llm_agrees": 1.4, "suffix_ing": 0.4, "suffix_ion": 0.8, "n_tokens": 0.1},
    "field": {"bias": -1.2, "head_type_match": 2.0, "exact_head_match": 0.8, "umbrella": 3.2, "kb_depth_shallow": 1.4, "all_lower": 0.3, "llm_agrees": 1.4, "orthographic": -0.6},
    "dataset": {"bias": -1.6, "head_type_match": 2.6, "exact_head_match": 1.6, "orthographic": 0.8, "has_upper": 0.4, "llm_agrees": 1.4},
    "metric": {"bias": -1.6, "head_type_match": 2.4, "exact_head_match": 1.6, "orthographic": 0.3, "llm_agrees": 1.4},
    "tool": {"bias": -1.8, "head_type_match": 1.8, "exact_head_match": 1.2, "orthographic": 1.0, "has_upper": 0.6, "llm_agrees": 1.4},
    "not_tech": {"bias": -0.15, "head_is_tech": -1.6, "head_type_match": -1.0, "orthographic": -0.8, "kb_hit": -1.2, "abbrev_pair": -0.8, "umbrella": -1.0, "llm_agrees": -0.6, "ncvalue": -0.2},
}
#: Weights of the prototype features: margin of technology over the rest, and likeness to the type's own prototype.
PROTO_TECH = {"artifact": 0.8, "method": 0.8, "material": 0.8, "tool": 0.8, "not_tech": -1.9}
PROTO_SELF = {t: 1.1 for t in TYPES}

GRANULARITY = {"field": 0, "task": 1, "method": 1, "artifact": 2, "material": 2, "dataset": 2, "metric": 1, "tool": 2, "not_tech": 2}

SECTION_WEIGHTS = {
    "title": 1.0, "abstract": 0.85, "claim_independent": 0.9, "patent_summary": 0.7, "method": 0.7, "claim_dependent": 0.55, "introduction": 0.5,
    "experiment": 0.45, "results": 0.4, "patent_detail": 0.35, "related_work": 0.25, "patent_background": 0.2, "conclusion": 0.5, "other": 0.3,
}
DEFAULT_SECTION_WEIGHT = 0.3

CONFIDENCE_WEIGHTS = {
    "bias": -1.55, "n_proposers": 0.62, "trusted_proposer": 0.85, "kb_hit": 0.70, "type_margin": 0.30, "type_prob": 1.25, "verifier_score": 1.10,
    "verifier_passed": 1.35, "verifier_llm": 0.45, "grounding_exact": 0.55, "section_weight": 0.40, "corpus_df": 0.22, "llm_proposed": 0.30,
    "verifier_abstained": -0.75, "guard_flags": -0.60, "distinctive_form": 0.80, "asserted_contribution": 0.65,
}

CANDIDATE_SCORE = {"proposers": 1.6, "kb": 1.4, "abbrev": 1.2, "llm": 1.0, "claim": 0.8, "nc": 0.6, "head": 0.5, "ortho": 0.35, "tokens": 0.3}

#: Signs of instructions inside data: (family, pattern), case-insensitive but for the fences.
INJECTION = (
    ("override", r"(?i)\b(ignore|disregard|forget|override)[ \t\n]+(all[ \t\n]+|any[ \t\n]+)?(the[ \t\n]+)?(previous|prior|preceding|earlier|above|system)[ \t\n]+(instruction|prompt|rule|direction|message)s?\b"),
    ("role_switch", r"(?i)\byou[ \t\n]+are[ \t\n]+(now[ \t\n]+)?(a|an|the)[ \t\n]+[A-Za-z0-9_]+"),
    ("role_marker", r"(?i)(^|\n)[ \t]*(system|assistant|user)[ \t]*:"),
    ("fence", r"(```|<\|[^\n]{0,20}\|>|\[/?INST\]|<<SYS>>)"),
    ("imperative_output", r"(?i)\b(respond|reply|answer|output|return|print)[ \t\n]+(only[ \t\n]+)?(with|the following)\b"),
    ("extraction_directive", r"(?i)\b(you[ \t\n]+must|always|never)[ \t\n]+(extract|include|report|classify|label|list)\b"),
    ("tool_directive", r"(?i)\b(call|invoke|execute|run)[ \t\n]+(the[ \t\n]+)?(function|tool|command|script)\b"),
)

TRUSTED = ("abbrev", "gazetteer")
DISTINCTIVE = ("abbrev", "gazetteer", "llm")

#: Modifiers without technical content, cut from the left of a phrase.
VAGUE_MODIFIERS = """
a an the this that these those such said its their our your his her my
one two three four five six seven eight nine ten first second third fourth
another other others certain various several many few some all both each
every any no more most least less further additional respective
present instant subject aforementioned above below following preceding
exemplary illustrative preferred alternative optional suitable appropriate
conventional typical usual ordinary common general generic particular
specific corresponding associated related given known new novel recent
current existing proposed described disclosed claimed
different same similar various number plurality
""".split()

#: (name, pattern, group): phrases that claims name technology in.
CLAIM_FRAMES = (
    ("means_for", r"(?i)\bmeans[ \t\n]+for[ \t\n]+([a-z][a-z-]*ing([ \t\n]+((the|a|an)[ \t\n]+)?[a-z][a-z-]*){0,3})", 1),
    ("configured_to", r"(?i)\b(a|an|the|said)[ \t\n]+(([a-z][a-z-]*[ \t\n]+){0,3}[a-z][a-z-]*)[ \t\n]+(configured|adapted|arranged|operable|designed)[ \t\n]+to\b", 2),
    ("wherein", r"(?i)\bwherein[ \t\n]+(the|said|a|an)[ \t\n]+(([a-z][a-z-]*[ \t\n]+){0,3}[a-z][a-z-]*)[ \t\n]+(comprises|includes|consists|is|are)\b", 2),
    ("applying", r"(?i)\b(applying|performing|using|employing|providing|forming|depositing|generating)[ \t\n]+((a|an|the|said)[ \t\n]+)?(([a-z][a-z-]*[ \t\n]+){0,3}[a-z][a-z-]*)\b", 4),
)

#: Characters that a word of an abbreviation's window counts for, and the most words of a long form.
WINDOW_WORD = 9
LONG_FORM_WORDS = 10

TECHNOLOGY_TYPES = ("artifact", "method", "material", "tool")
