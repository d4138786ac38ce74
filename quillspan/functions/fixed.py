"""Word lists, tables and patterns whose values are part of the results."""

# Patterns of spoken filler.
FILLER_TOKENS = "(?i)\\b(?:um|uh|uhm|hmm|hm|mhm|erm)\\b[,;]?\\s*"
FILLER_PHRASES = "(?i)\\b(?:you know|I mean|kind of|sort of|like,)\\s*"
SENTENCE_INITIAL = "(?i)(?:^|(?<=[.!?])\\s*)(?:So,?\\s+|Okay,?\\s+|OK,?\\s+|All right\\.?\\s*|Right,?\\s+|And so,?\\s+|Well,?\\s+)"

# Patterns of on-screen text without content.
NOISE_PATTERNS = [
    "(?i)\\bsubscribe\\b",
    "(?i)\\blike\\b.{0,20}\\bshare\\b",
    "(?i)\\bshare\\b.{0,20}\\blike\\b",
    "(?i)\\bnotification\\b",
    "(?i)\\bbell\\s+icon\\b",
    "\\b@[A-Za-z0-9_]+\\b",
    "https?://\\S+",
    "(?i)\\bwatermark\\b",
    "(?i)\\blogo\\b.{0,20}\\bchannel\\b",
    "(?i)\\boutro\\b",
    "(?i)\\bthank\\s+you\\s+for\\s+watching\\b",
    "(?i)\\bdon['']t\\s+forget\\s+to\\b",
]

# Suffix and replacement, the first that fits.
PLURAL_RULES = [("ies", "y"), ("ves", "f"), ("xes", "x"), ("ches", "ch"), ("shes", "sh"), ("sses", "ss"), ("ses", "s"), ("zes", "z"), ("s", "")]

# Words that carry no content in answers.
ANSWER_STOPWORDS = (
    "a an the and or but if because as what which this that these those then just so than such both through about for is of "
    "while during to from in out on off again further once here there when where why how all any both each few more most other "
    "some such no nor not only own same too very can will should now are was were be been being have has had having do does did "
    "doing would could"
).split()

# How names of clauses begin, and abbreviations that a name may end with.
FRAGMENT_OPENERS = "us we they it he she you this that these those which who because since although but and or so then".split()
ABBREVIATION_ENDS = ["Inc.", "Corp.", "vs.", "e.g.", "i.e."]

# Relation types, and the weight of each for "source comes before target" (along and against the edge).
RELATIONS = ["PREREQUISITE_OF", "INTRODUCED_BEFORE", "USED_BY", "DERIVED_FROM", "VISUALIZED_BY", "EXPLAINS"]
PREREQUISITE_WEIGHTS = {
    "PREREQUISITE_OF": (1.0, 0.0),
    "INTRODUCED_BEFORE": (0.70, 0.0),
    "DERIVED_FROM": (0.0, 0.80),
    "USED_BY": (0.20, 0.0),
    "EXPLAINS": (0.10, 0.0),
    "VISUALIZED_BY": (0.0, 0.0),
}
ENTITY_TYPES = ["Concept", "Algorithm", "Formula", "Code", "Diagram", "LectureSegment"]

# Predicate -> relation; those in the second table point the other way.
PREDICATES = {
    "PREREQUISITE_OF": "prerequisite_of is_prerequisite_of precedes_conceptually",
    "USED_BY": "used_by utilized_by consumed_by operated_on_by is_used_by",
    "DERIVED_FROM": "derived_from calculated_from computed_from built_from sourced_from induced_by",
    "INTRODUCED_BEFORE": "introduced_before taught_before presented_before prior_to",
    "EXPLAINS": "explains describes illustrates defines clarifies modeled_by",
    "VISUALIZED_BY": "visualized_by shown_in depicted_by",
}
INVERTED_PREDICATES = {
    "PREREQUISITE_OF": "depends_on requires prerequisite needs relies_on",
    "USED_BY": "uses operates_on utilizes employs applies_to calls invokes",
    "DERIVED_FROM": "derives produces yields forms creates generates induces constitutes",
    "INTRODUCED_BEFORE": "introduced_after taught_after follows",
    "EXPLAINS": "explained_by described_by defined_by",
    "VISUALIZED_BY": "visualizes depicts",
}

# Patterns of questions about structure and about content.
GRAPH_PATTERNS = [
    r"\bprerequisites?\b", r"\brelated\b", r"\brelations?\b", r"\brelat(e|es|ing)\b",
    r"(?<!fully\s)(?<!fully-)\bconnect(s|ed|ing|ion|ions)?\b", r"\bbefore\b.{0,30}\bafter\b", r"\btaught before\b", r"\btaught after\b",
    r"\bwhy\b.{0,20}\bbefore\b", r"\bdepend(s|ency|encies)?\b", r"\brequire[sd]?\b", r"\bpaths?\b", r"\blinks?\b", r"\brelationships?\b",
    r"\bleads?\s+to\b", r"\bbuilt\s+on\b", r"\bfound(ation|ations|ational)?\b", r"\buse[sd]\s+by\b",
]
VECTOR_PATTERNS = [
    r"\bsummariz(e|ing)\b", r"\bexplain\b", r"\bwhat\s+was\s+said\b", r"\bdescribe\b", r"\bsection\b", r"\bdetail\b",
    r"\btell\s+me\s+about\b", r"\bhow\s+does\b", r"\bdefine\b", r"\bmeaning\b",
]
LEARNING_PATH_PATTERNS = [r"\blearning\s+path\b", r"\bhow\s+to\s+study\b", r"\bwhat\s+to\s+learn\b"]
QUIZ_PATTERNS = [
    r"\bquiz(zes)?\b", r"\btest\s+me\b", r"\bpractice\s+(questions?|problems?|exercises?|tests?|exams?)\b",
    r"\b(generate|create|make|write|prepare|give\s+me)\b.{0,30}\b(questions|mcqs?)\b", r"\b(exam|mcq|multiple[\s-]choice)\s+questions?\b",
]
FLASHCARD_PATTERNS = [r"\bflashcards?\b", r"\bstudy\s+cards?\b", r"\bkey\s+terms\b"]
NOTES_PATTERNS = [r"\bnotes\b", r"\bstudy\s+notes?\b", r"\b(generate|make|create|write|take|prepare|give\s+me)\b.{0,20}\bnote\b"]
SUMMARY_PATTERNS = [
    r"\bsummar(y|ize|ization|ise)\b", r"\brecap\b", r"\boverview\b", r"\blecture\s+summary\b", r"\bgive\s+(me\s+)?a\s+summary\b",
    r"\bwhole\s+lecture\b", r"\bentire\s+lecture\b", r"\ball\s+(of\s+)?the\s+(topics|concepts|content)\b", r"\bkeypoints?\b",
    r"\bkey\s+points?\b", r"\bmain\s+(points?|ideas?|topics?)\b", r"\bexplain\s+(the|this|today'?s?)\s+lecture\b",
    r"\bexplain\w*\s+what\s+(is\s+)?in\s+(this|the)\s+lecture\b",
    r"\bwhat(?:'?s|\s+is)?\s+(?:explain\w*|covered|taught|discussed)\s+in\s+(this|the)\s+lecture\b",
    r"\bwhat(?:'?s|\s+is)?\s+(the|this|today'?s?)\s+lecture\s+(about|on|covering|explain\w*)\b",
    r"\bwhat\s+does\s+(this|the)\s+lecture\s+(cover|explain|teach|discuss|contain)\b",
    r"\blecture\s+(covers|explains|teaches|discusses|is\s+about)\b", r"\bkey\s+(concepts|takeaways)\b", r"\btopics\s+(are\s+)?covered\b",
    r"\bwhat\s+(topics|concepts|ideas)\s+(are\s+)?(covered|discussed|taught|explained)\b", r"\bwhat\s+did\s+we\s+learn\b",
    r"\boverview\s+of\s+(the|this|today'?s?)\s+lecture\b",
]
COMPARISON_PATTERNS = [r"\bcompare\b", r"\bvs\.?\b", r"\bversus\b", r"\bdifference\b", r"\bsimilar(ity|ities)?\b", r"\bbetter\b", r"\bworse\b"]
DEFINITION_PATTERNS = [r"\bdefin(e|ition)\b", r"\bwhat\s+does\b.{0,20}\bmean\b", r"\bmeaning\s+of\b", r"\bterm\b"]
REASONING_PATTERNS = [r"\bwhy\b", r"\bcause\b", r"\bcauses?\b", r"\bbecause\b", r"\bwhat\s+happens\b", r"\bwhat\s+if\b", r"\bimpact\b", r"\beffect\b"]
VISUAL_PATTERNS = [r"\bdiagram\b", r"\bfigure\b", r"\bimage\b", r"\bslide\b", r"\bvisual\b"]

# Words of requests that name no topic.
SCOPE_WORDS = (
    "give gave provide write make create generate prepare list tell show please can could would will you explain explained "
    "explaining explains describe go over through walk help want need like summary summaries summarize summarise summarizing "
    "summarising summarization summarisation recap overview outline brief briefly short quick quickly detailed key main important "
    "points point ideas idea topics topic concepts concept takeaways takeaway highlights highlight keypoints keypoint content "
    "contents everything things stuff lecture lectures class course session lesson video talk today todays whole entire all each "
    "every section sections part parts slide slides far cover covers covered covering discuss discusses discussed teach teaches "
    "taught learn learned learnt learning contain contains said mentioned presented notes note study flashcards flashcard cards "
    "card terms term quiz quizzes test questions question practice exam mcq mcqs path how what to the a an this that these those "
    "is are was were be been do does did done have has had of on in at by for from about with and or it its we us me my our i so up "
    "some any which there here now then s"
).split()

# Words of queries that name no entity.
ENTITY_STOPWORDS = (
    "what which how why when where who does did the and are was were with from that this have has had for its not but you your "
    "about into can could will would shall should than then there their they is it of to in on at by be or as an a lecture lectures "
    "explain explained explaining give given tell called using used use via such like"
).split()

# Names that are no concepts.
GENERIC_NAMES = (
    "thing things example examples important process processes system systems this that it they video videos series topic "
    "information component setup action actions function functions approach overview intro conclusion"
).split()

# How an answer says that it can't answer.
REFUSALS = ["insufficient evidence", "not enough evidence", "cannot answer", "does not provide enough information", "no evidence", "unable to answer"]

# Other names of entity types.
ENTITY_TYPE_ALIASES = {"variable": "Concept", "textelement": "Concept"}

#: Cues that one term {A} comes before another {B}, with scores and names, in order of search.
CUE_PATTERNS = [
    (r"\b{A}\b[^.]{1,80}\bis\s+(?:a\s+)?prerequisite\s+(?:for|to)\s+\b{B}\b", 1.0, "explicit_prerequisite"),
    (r"\bprerequisite\s+(?:for|to)\s+\b{B}\b[^.]{1,80}\bis\s+\b{A}\b", 1.0, "explicit_prerequisite_rev"),
    (r"\bwithout\s+(?:understanding\s+|knowing\s+)?\b{A}\b[^.]{1,80}(?:cannot|can't|impossible\s+to)\s+(?:understand|grasp|follow)\s+\b{B}\b", 0.95, "negative_necessity"),
    (r"\b{B}\b[^.]{1,60}\bcan\s+only\s+(?:work|operate|function)\s+(?:using|with|by|if\s+there\s+is)\s+(?:an?\s+)?\b{A}\b", 0.95, "only_works_with_requirement"),
    (r"\bwhy\s+only\s+(?:an?\s+)?\b{A}\b\s+can\s+be\s+used\s+in\s+\b{B}\b", 0.95, "why_only_used_requirement"),
    (r"\bbefore\s+(?:we\s+)?(?:move\s+on\s+to|discuss|discussing|look\s+at|talk\s+about|understand|learn)\s+\b{B}\b[^.]{1,80}(?:let\s*\'?s|let\s+us|we|must|first|need\s+to|should)\s+(?:first\s+)?(?:understand|look\s+at|know|cover|review)\s+\b{A}\b", 0.95, "pedagogical_precedence"),
    (r"\b(?:need|have|require)\s+to\s+(?:know|understand|master)\s+\b{A}\b[^.]{1,80}(?:in\s+order\s+to|to)\s+(?:understand|know|study|implement)\s+\b{B}\b", 0.95, "understanding_requirement"),
    (r"\bin\s+order\s+to\s+(?:understand|grasp|follow)\s+\b{B}\b[^.]{1,80}(?:you|we|one)?\s*(?:first\s+)?(?:must|need\s+to|have\s+to)\s+(?:understand|know)\s+\b{A}\b", 0.95, "in_order_to_requirement"),
    (r"\b{A}\b[^.]{1,80}\b(?:are\s+manufactured\s+to\s+be|can\s+be\s+(?:classified|categorized|divided|split)\s+into|come\s+in\s+two\s+(?:types|forms)\s*(?:such\s+as|like|:)?|can\s+be\s+either|are\s+usually\s+in\s+a)\s+[^.]{0,60}\b{B}\b", 0.9, "specialization_subdivision"),
    (r"\b{B}\b[^.]{0,60}\b(?:is\s+a\s+(?:type|form|kind|specialization|variation)\s+of|is\s+simply\s+a|are\s+made\s+from\s+(?:either\s+)?(?:three\s+)?(?:separate\s+)?)\s+\b{A}\b", 0.9, "specialization_type_of"),
    (r"\b{A}\b\s+(?:configuration|system|setup)\s+(?:is\s+)?(?:known\s+as|called|referred\s+to\s+as|designated\s+as)\s+(?:a\s+|an\s+)?\b{B}\b", 0.85, "topological_configuration"),
    (r"\b{B}\b[^.]{1,60}\b(?:refers\s+to|consists\s+of|is\s+a\s+configuration\s+of)\s+[^.]{1,60}\b{A}\b", 0.85, "config_reference"),
    (r"\b(?:change\s+in|fluctuation\s+in|alternation\s+(?:of|in)|flow\s+of)\s+\b{A}\b[^.]{1,60}\b(?:creates|generates|produces|induces|results\s+in)\s+(?:a\s+|an\s+|the\s+)?(?:fluctuating\s+|changing\s+|varying\s+|dynamic\s+)?\b{B}\b", 0.85, "causal_generation"),
    (r"\bpass\s+(?:an?\s+)?\b{A}\b[^.]{1,40}\bthen\s+(?:the\s+)?\b{B}\b\s+will\s+(?:fluctuate|vary|increase|decrease|change|reverse)\b", 0.85, "signal_variation"),
    (r"\b(?:change\s+in\s+(?:the\s+)?(?:intensity\s+and\s+direction\s+of\s+(?:the\s+)?|fluctuation\s+of\s+(?:the\s+)?)|fluctuating\s+)\b{A}\b[^.]{1,60}\b(?:forces\s+(?:them|electrons)\s+to\s+move|produces|induces)\s+[^.]{1,60}\b{B}\b", 0.85, "inductive_generation"),
    (r"\b{A}\b\s+(?:constantly\s+)?(?:disturbs|induces|creates|generates|produces|causes)\b[^.]{0,100}\.\s+this\s+(?:movement|force|action|induction|effect|phenomenon)\s+(?:is\s+known\s+as|is\s+called|causes|induces|produces|results\s+in)\s+[^.]{0,80}\b{B}\b", 0.9, "anaphoric_induction"),
    (r"\b{B}\b[^.]{1,60}\b(?:is\s+induced|is\s+generated|arises\s+from|occurs\s+due\s+to)\s+(?:due\s+to|because\s+of|from\s+the\s+(?:changing|fluctuating|varying))\s+\b{A}\b", 0.85, "passive_generation"),
    (r"\b{B}\b[^.]{1,60}\b(?:relies\s+on|depends\s+on|builds\s+upon|builds\s+on|is\s+based\s+on)\s+(?:the\s+mechanism\s+(?:we\s+discussed\s+earlier,?\s*)?)?\b{A}\b", 0.9, "reliance_dependency"),
    (r"\b(?:recall|remember)\s+\b{A}\b[^.]{1,60}(?:because|since|as)\s+we(?:'ll|\s+will)?\s+(?:use|need)\s+it\s+(?:here\s+)?(?:for|in)?\s*\b{B}\b", 0.85, "recall_relevance"),
    (r"\b{A}\b[^.]{1,60}\bis\s+(?:needed|required|essential|fundamental)\s+for\s+\b{B}\b", 0.85, "essential_foundation"),
]

#: Last words that a long term may be without.
GENERIC_HEAD_NOUNS = ["connection", "configuration", "circuit", "concept", "type", "device", "phenomenon", "mechanism"]

# What a written title may begin with, marks in it, and its stand-in.
TITLE_PREFIX = r"(?i)^\s*(?:title|caption|segment|topic|heading)\s*\d*\s*[:\-.]\s*"
TITLE_MARKS = "[#*`_>]+"
UNTITLED = "Untitled Segment"

# Boilerplate in descriptions of slides.
SLIDE_HEADER = r"(?i)###\s*Educational\s+Slide\s+Description\s*"
SLIDE_BACKGROUND = r"(?i)####\s*Background\s*-\s*[^\n]+"

# Verbs by which a sentence relates two things.
RELATION_INDICATORS = (
    r"(?i)\b(require|requires|used\s+in|uses|work\s+using|operates\s+on|creates|induce|induces|emits|guides|reduce|reduces|heats\s+up|"
    r"increase|increases|decrease|decreases|caused\s+by|disturbs|forces|means\s+that|known\s+as|loss|connect|connected|wired)\b"
)

# How clauses begin, what they hold, and a sentence end inside a name.
CLAUSE_PATTERNS = [
    r"(?i)^(us\s+a|and\s+then|this\s+means|because\s+the|which\s+means|gives\s+us|so\s+that|therefore\s+we|to\s+fix|now\s+the|we\s+will|that\s+is|due\s+to)\b",
    r"(?i)\b(is\s+important\s+because|can\s+only\s+work|will\s+be\s+able\s+to|referring\s+to|known\s+as)\b",
    r"[\.!\?]\s+[A-Z]",
]

# Words without a topic, marks of boilerplate on slides, and how captions without a topic begin.
TITLE_STOPWORDS = (
    "the and of to in on for with that this is are was were be been being a an as at by from or but not so if then than there their they "
    "them we you your it its what which who whom when where why how do does did have has had can could will would should may might must "
    "about into over under again once here all any both each few more most other some such only own same too very just also well really "
    "actually basically okay ok um uh yeah right like kind sort thing things one two three let lets going gonna want need talk talking say "
    "said says see look looking lecture lectures today guys everyone welcome thank thanks question questions answer answers example "
    "examples maybe even still much back now always never sometimes usually often next last part section slide slides page chapter module course"
).split()
SLIDE_BOILERPLATE = [
    "subscribe", "notification", "share", "watching", "thank you", "parental", "permission", "adults", "copyright", "disclaimer", "bell",
    "watermark", "logo", "channel", "like this", "comment",
]
CAPTION_OPENERS = [
    "the image", "this image", "the picture", "this picture", "image of", "this appears", "the screenshot", "this screenshot", "the photo",
    "educational slide", "this slide", "the slide", "a slide", "description", "key objects", "key concepts", "key points", "main points",
    "overview of", "this diagram", "the diagram", "a diagram", "the figure",
]
CAPTION_WORDS = "images pictures photos screenshots figures shows shown showing contains including appear appears".split()

# Files of a package, those it may have besides, and those that never leave the machine that made them.
PACKAGE_FILES = [
    "manifest.json", "chunk_segment_map.json", "entities.json", "relations.json", "segments.json", "multimodal_chunks.json",
    "embeddings.npy", "embedding_ids.json", "metadata.json", "triplets.json",
]
OPTIONAL_PACKAGE_FILES = ["prerequisites.json"]
EXCLUDED_FILES = ["vlm_output.jsonl", "ocr_output.jsonl", "transcript.json", "frames.json", "training_metrics.json"]
EXCLUDED_FOLDERS = ["frames", "logs"]
