"""Word lists and tables that results depend on. Stated as they must be, in their natural order."""

# Words without content, and words that only carry a question.
STOP = """a an the of to in and is are was were be been being for on with as at by
from that this these those it its into or not no can may might will would
should could shall must do does did has have had than then so such but if
while when where which who whom whose what how why also because between
within without about above below over under again further once here there
all any both each few more most other some own same too very s t just don
now i we you they he she him her his their our your my me us them one two
three following best which except true false statement option answer
question correct incorrect not except is""".split()
STOP_AR = """من عن في علي الي و او ان لم لن لا ليس ليست كان يكون تكون هي هو هم هما
التي الذي الذين هذا هذه ذلك تلك كل بعض بين حيث عند قبل بعد اي اذا ثم كما
مع منه منها فيه فيها عنه عنها هل فوق تحت داخل خارج نحو حتي لكن لان قد سوف
انه انها منها""".split()
SCAFFOLD = """what which who whom whose how why when where is are was were be been
being does do did has have had explain explains explained describe
describes described define defined state states identify
identifies name names list lists outline outlines summarize summarises
summary give gives mention mentions true false statement option answer
question following except correct incorrect best which""".split()
SCAFFOLD_AR = """ما ماذا لماذا كيف هل عرف اذكر اشرح وضح قارن لخص عدد حدد صف صح خطا صحيح
صحيحه مقارنه المقصود اشرحي""".split()

# Words of one meaning, each group known by its first.
SYNONYMS = [
    "main primary principal chief key core",
    "purpose function role aim goal objective",
    "meaning definition defined defines define means term",
    "difference differ differs different distinguish compare comparison contrast",
    "produce produces produced generate generates create creates yield yields form forms",
    "cause causes reason reasons trigger",
    "effect effects outcome outcomes consequence result results",
    "process mechanism procedure method",
    "step steps stage stages phase phases sequence",
    "increase increases rise rises",
    "decrease decreases decline reduce reduces",
    "important significant essential crucial vital",
    "characteristic characteristics feature features property properties trait traits",
    "relationship relation connection link",
    "happen happens occur occurs",
    "affect affects influence influences impact",
    "environmental environment surrounding",
    "condition conditions factor factors",
    "وظيفه دور هدف الهدف الغرض غايه",
    "معني تعريف يعرف يعني تعني مفهوم",
    "فرق الفرق اختلاف يختلف اختلف قارن مقارنه",
    "اشرح يشرح وضح صف اذكر عدد لخص",
    "سبب السبب يسبب تودي يودي نتيجه ينتج اثر يوثر",
    "عمليه اليه طريقه اجراء",
    "خطوه خطوات مرحله مراحل ترتيب تسلسل",
    "يزيد زياده يرتفع ارتفاع",
    "يقل انخفاض ينخفض تناقص",
    "مهم اهميه اساسي جوهري",
    "خاصيه خصايص صفه سمه ميزه",
    "علاقه العلاقه ارتباط صله",
    "خاطي خطا",
    "صحيح صحيحه صح",
    "يحدث تحدث يقع",
]

# Phrases that tell the skill that a question asks for; the first rule that meets wins, the last is the default.
SKILLS = [
    ("misconception", ["incorrect", "not true", "is wrong", "false", "except", "misconception", "does not", "cannot", "which statement is wrong", "غير صحيح", "خاطي", "ما عدا", "الخطا", "ليست", "ليس"]),
    ("comparison", ["differ", "difference", "different", "compare", "contrast", "versus", "similar", "unlike", "whereas", "distinguish", "الفرق", "قارن", "مقارنه", "يختلف", "اختلاف", "بينما", "على عكس", "تشابه"]),
    ("process_order", ["step", "stage", "phase", "sequence", "order", "first", "next", "then", "follows", "followed by", "which step", "occurs next", "process", "work", "works", "produce", "produced", "generate", "generated", "الخطوه", "خطوات", "مرحله", "ترتيب", "تسلسل", "التالي", "العمليه", "ينتج", "يتم انتاج"]),
    ("cause_effect", ["why", "because", "reason", "cause", "effect", "affect", "leads", "results in", "due to", "therefore", "consequence", "impact", "لماذا", "السبب", "بسبب", "نتيجه", "يودي", "يسبب", "تاثير", "اثر"]),
    ("application", ["what would happen", "scenario", "demonstrates", "demonstrate", "example", "apply", "predict", "suppose", "given", "ماذا يحدث لو", "سيناريو", "مثال", "لنفترض", "توقع", "يطبق"]),
    ("analysis", ["infer", "inference", "conclusion", "conclude", "best supported", "evidence supports", "analyze", "analysis", "relationship", "can be deduced", "استنتاج", "يستنتج", "حلل", "العلاقه"]),
    ("understanding", ["explain", "explains", "describe", "describes", "how", "main purpose", "primary function", "main idea", "main function", "purpose", "function", "role", "best explains", "best describes", "summarize", "relation", "why is", "اشرح", "وضح", "وظيفه", "لخص", "الفكره", "الغرض"]),
    ("factual_recall", []),
]
PATTERNS = [
    ("incorrect", ["incorrect", "except", "not true", "false", "which statement is wrong", "غير صحيح", "خاطي", "ما عدا", "الخطا"]),
    ("comparison", ["differ", "difference", "compare", "contrast", "versus", "unlike", "whereas", "الفرق", "قارن", "يختلف"]),
    ("hypothetical", ["what would happen", "scenario", "demonstrates", "suppose", "predict", "if", "ماذا يحدث لو", "سيناريو", "لنفترض"]),
    ("process_step", ["step", "stage", "order", "sequence", "next", "followed by", "occurs next", "الخطوه", "مرحله", "ترتيب", "التالي"]),
    ("purpose", ["purpose", "function", "role", "main idea", "main aim", "goal", "الغرض", "الوظيفه", "الهدف", "الفكره"]),
    ("conclusion", ["conclusion", "best supported", "infer", "implies", "suggests", "استنتاج", "يستنتج"]),
    ("relationship", ["relationship", "relation", "between", "العلاقه", "بين"]),
    ("why_reason", ["why", "because", "reason", "لماذا", "السبب"]),
    ("definition", ["what is", "define", "definition", "means", "refers to", "ما هو", "ما هي", "عرف", "تعريف", "معني"]),
    ("which_statement", []),
]

# Kinds of furniture in documents, by patterns over normalised text.
FURNITURE = [
    ("copyright", r"\bcopyright\b"),
    ("all-rights-reserved", r"all rights reserved"),
    ("trademark", r"\btrademarks?\b|\bregistered marks?\b"),
    ("isbn", r"\bisbn\b"),
    ("doi", r"\bdoi\b|\bdigital object identifier\b"),
    ("issn", r"\bissn\b"),
    ("publisher", r"\bpublish(ed|er|ers|ing|es)?\b"),
    ("licensing", r"\blicen[cs]e(d|ing)?\b|\bpermission of\b"),
    ("legal", r"\bterms of (use|service)\b|\bprivacy policy\b|\blegal notice\b|\bunauthorized\b|\bproprietary\b|\bconfidential\b|\bdo not (copy|distribute|sell)\b|\bmay not be (reproduced|copied|distributed)\b|\bno part of this\b"),
    ("page-folio", r"\bpages?\s*\d+(\s*-\s*\d+)?\b"),
    ("arabic-legal", r"حقوق النشر|حقوق الطبع|جميع الحقوق محفوظه|كل الحقوق محفوظه|الطبع والنشر|دار النشر|الناشر|رقم الايداع|ترخيص|علامه تجاريه"),
]
# The same over the text as it stands.
RAW_FURNITURE = [
    ("copyright-symbol", r"[©®™Ⓒⓒ]"),
    ("url", r"(?i)https?://\S+|www\.\S+"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("isbn", r"(?i)\bisbn[:\s]*[\d\-xX]{8,}\b"),
    ("issn", r"(?i)\bissn[:\s]*\d{4}[- ]\d{3}[\dxX]\b"),
    ("doi", r"\b10\.\d{4,9}/[-._;()/:a-zA-Z0-9]+\b"),
]
# Lines that are furniture.
STRONG_LINE = r"(?i)all rights reserved|may not be (reproduced|copied|distributed|transmitted|used)|no part of this|unauthorized (use|reproduction|copying)|do not (copy|distribute|sell)|registered trademarks?|trademarks? of|جميع الحقوق محفوظه|حقوق النشر|حقوق الطبع"
STARTING_LINE = r"(?i)^\s*(published by|publisher|printed (in|by)|printing|for more information|visit us|visit our|call us|terms of use|privacy policy|legal notice|copyright|©|®|™|confidential|proprietary|internal use only|دار النشر|الناشر|طبع|طبعه|رقم الايداع|ايداع)"
FOLIO_LINE = r"(?i)^(page|صفحة|صفحه)\s*\d+(\s+(of|من)\s*\d+)?\s*$"
PRESS_LINE = r"(?i)^(?:(?:[\w&'’\-]+\s+){0,5}(?:university\s+)?press(?:,?\s+\w+)*|(?:first|second|third|fourth|fifth|revised|international)\s+edition)$"

# Markers of what a sentence teaches, in the order in which they are tried.
KNOWLEDGE = [
    ("definition", r"\b(is|are)\s+defined\s+as\b|\brefers?\s+to\b|\bis\s+known\s+as\b|\bis\s+called\b|\bmeans\s+that\b|\bis\s+the\s+(study|process|term|name)\b|\bcan\s+be\s+defined\b|يعرف|تعرف|يقصد ب|هو عباره عن|هي عباره عن"),
    ("comparison", r"\b(unlike|whereas|while\b.{0,60}\b(but|however)|in contrast|compared (to|with)|differs? from|difference between|similar to|both\b.{0,40}\band\b|rather than|instead of|distinguish\w*)\b|على عكس|بينما|مقارنه|يختلف عن|الفرق بين"),
    ("cause_effect", r"\b(because|therefore|thus|hence|causes?|caused by|leads? to|results? in|due to|depends? on|so that|consequently|if\b.{0,60}\bthen|increases?|decreases?|affects?|enables?|prevents?|allows?)\b|يسبب|يودي الي|بسبب|نتيجه|لذلك|يعتمد علي|يمنع|يسمح"),
    ("classification", r"\b(types? of|kinds? of|categor\w+|classif\w+|divided into|consists? of|grouped into|forms? of|exists? in two)\b|انواع|تصنيف|ينقسم الي|يتكون من"),
    ("process", r"\b(process|procedure|mechanism|steps?|stages?|phases?|cycle|sequence|first|then|next|finally|proceeds?|converts?|synthes\w+|assembl\w+|produces?|generates?|transforms?|replicat\w+|transcrib\w+|translat\w+|iterat\w+)\b|عمليه|خطوات|مراحل|اليه|يتم انتاج|يتم تحويل"),
    ("principle", r"\b(law of|principle|theorem|rule|axiom|postulate|states? that|equation|formula|must always|never|theory states)\b|=|قانون|مبدا|نظريه|قاعده|معادله"),
    ("example", r"\b(for example|for instance|such as|e\.g\.|as an example|consider the case|commonly (called|remembered|abbreviated)|mnemonic)\b|مثال|علي سبيل المثال"),
]


def begun(stems: str) -> str:
    """A pattern of words that begin with one of the stems, dealt out by their first letters."""
    by_letter: dict[str, list[str]] = {}
    for stem in stems.split():
        by_letter.setdefault(stem[0], []).append(stem[1:])
    return r"\b(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(by_letter.items())) + ")"


#: What every marker of KNOWLEDGE begins with (of is, are, can and in also what follows), or any Arabic letter.
KNOWLEDGE_BEGUN = "(?i)" + begun(
    r"""is\s+(?:defined|known|called|the) are\s+defined refer means can\s+be unlike whereas while in\s+contrast in\scontrast compared differ similar both rather instead distinguish
    because therefore thus hence cause lead result due depend so\sthat consequently if increase decrease affect enable prevent allow type kind categor classif divided consist grouped form exist
    process procedure mechanism step stage phase cycle sequence first then next finally proceed convert synthes assembl produce generate transform replicat transcrib translat iterat
    law principle theorem rule axiom postulate state equation formula must never theory for\s(?:example|instance) such e\.g as\s consider common mnemonic"""
) + "|[=\u0600-\u06ff]"

# Verbs that make a line a statement, and words after which a verb's form is a noun.
PREDICATES = """is are was were be been being has have had do does did can could may might must
should would will shall uses use used using occurs occur occurred produces produce
produced contains contain containing refers refer referred means mean meant states
state stated requires require required causes cause caused leads lead led consists
consist consisting includes include including defines define defined describes
describe described generates generate generated equals equal becomes become forms
form formed allows allow allowed regulates regulate regulated separates separate
separated breaks break carries carry carried converts convert converted stores
store stored provides provide provided results result resulting depends depend
increases increase increased decreases decrease decreased happens happen happened
proceeds proceed synthesizes synthesize synthesized reads read assembles assemble
modifies modify modified packages package packaged houses house housed lacks lack lacked""".split()
DETERMINERS = "the a an this that these those its their his her our your some any all both each every no several many few more most other".split()
NAMED_HEADING = r"(?i)^\s*(chapter|section|part|unit|module|lesson|topic|appendix|figure|table|الفصل|القسم|الجزء|الوحدة|الدرس|الباب|الموضوع|شكل|جدول)\b"
GENERIC_LABELS = ["introduction", "conclusion", "summary", "chapter summary", "overview", "review", "review question", "review questions", "chapter review", "exam tip", "key exam tip", "objectives", "learning objectives", "table of contents", "contents", "references", "bibliography", "appendix", "glossary", "index", "preface", "exercises", "key terms", "further reading", "مقدمه", "خلاصه", "ملخص", "مراجعه", "اهداف", "فهرس", "مراجع"]
TRIVIAL = r"\bpages?\s*\d|what page|which page|how many pages|\bisbn\b|\bword count\b|how many words|\bnumber of words\b|\bcopyright\b|all rights reserved|\btable of contents\b|\bcontents\b|\bappendix\b|\breferences\b|\bbibliography\b|\bheader\b|\bfooter\b|\bpublished\b|\btitle of\b|\bauthor name\b|\bedition\b|\bprint(ed|ing)\b|\bpage size\b"

# What opens a sentence without naming what it is about.
DISCOURSE_OPENER = (
    r"(?iU)^\s*(?:in\s+(?:contrast|summary|addition|fact|other\s+words|general|particular)|unlike|instead|rather|similarly|likewise|conversely|nevertheless|meanwhile|"
    r"together|overall|finally|first|second|third|next|then|also|because(?:\s+of)?|however|therefore|thus|hence|moreover|furthermore|although|though|while|whereas|since|"
    r"for\s+example|for\s+instance|as\s+a\s+result|consequently|on\s+the\s+other\s+hand|by\s+contrast|many\s+students|students|a\s+key\s+exam\s+tip|each\s+group|"
    r"this|these|those|it|they|there|such|both|every|some|many|most|understanding|remember|note)\b[\s,]*"
)
LEADING_DETERMINER = r"(?iU)^(?:the|a|an)\s+"
LEADING_ADVERB = r"(?iU)^[A-Za-z]+ly\b[\s,]*"
LEADING_SUBORDINATE = r"(?iU)^\s*(?:although|though|even\s+though|while|whereas|whilst|if|unless|when|whenever|because|since|as\s+long\s+as|provided\s+that|in\s+order\s+that|so\s+that|after|before|until)\b[^,]{3,120},\s*"
CORRELATIVE = r"(?iU)^\s*the\s+(?:\w+er|more|less|greater|smaller|larger|fewer|higher|lower)\b[^,]{3,120},\s*the\s+(?:\w+er|more|less|greater|smaller|larger|fewer|higher|lower)\b"
ANAPHORIC = (
    r"(?iU)^\s*(?:it|they|this|these|the\s+(?:process|structure|organelle|component|mechanism|algorithm|method|technique|rule|law|principle|theorem|reaction|system|device|"
    r"element|compound|molecule|enzyme|force|function|operation|procedure|phenomenon|concept|term|quantity|value|unit|stage|phase|step))\b"
)
# The words of a term, and what stands behind a term that is being defined.
TERM = r"[A-Za-z][A-Za-z0-9'’\-]*(?:\s+[A-Za-z][A-Za-z0-9'’\-]+){0,3}"
SUBJECT = r"[A-Za-z][A-Za-z0-9'’\-]*(?:\s+[A-Za-z][A-Za-z0-9'’\-]+){0,4}"
DEFINING = [r"\s+(?:is|are)\s+defined\s+as\b", r"\s+refers?\s+to\b", r"\s+(?:is|are)\s+(?:the|a|an)\b", r"\s+(?:is|are)\s+(?:called|known\s+as)\b"]
DEFINING_AR = (r"[؀-ۿ][؀-ۿ\s]{2,40}?", r"\s+(?:هو|هي)\s")
ALIAS = r"([A-Za-z][\w\- ']{2,60}?)\s*(?:\(\s*([A-Za-z][\w\-]{1,20})\s*\)|,?\s*(?:commonly\s+)?(?:abbreviated|known|referred\s+to|called)\s+(?:as\s+)?([A-Za-z][\w\- ']{1,40}?)(?=[,.;]|$))"
ALIAS_DECLARED = r"\(\s*[A-Za-z][\w\-]{1,20}\s*\)|(?:abbreviated|known|referred\s+to|called)\s"
# Words at which a name ends and the claim begins; words that open a clause; words that open a complement.
PREDICATE_STOP = """is are was were be been being has have had do does did can could may might must
should would will shall which that who whose when where while to for with from by
consists contains includes occurs occur uses use used produces produce generate
generates refers refer means mean states state exists exist proceeds proceed lacks lack
breaks break carries carry houses house converts convert modifies modify allows
allow regulates regulate assigns assign selects select chooses choose schedules
schedule executes execute runs run holds hold requires require provides provide
describes describe measures measure represents represent equals equal gives give
takes take makes make keeps keep prevents prevent enables enable causes cause
determines determine depends depend applies apply write writes writing said says""".split()
SUBORDINATORS = "although though while whereas whilst if unless when whenever because since after before until so that which who whose where why how".split()
COMPLEMENT_OPENERS = """the a an to from into onto with by for in on at as than between
through against among upon over under toward towards about that this these those its their his her our your only completely partially entirely
always never often usually specifically directly when where how why""".split()
NOUN_ENDING = r"(?i)(?:ss|us|is|ics|ness|ies|sis|ses|nces|ments|tions|sions|ions)$"
STRANDED = r"(?:then|now|later|soon|thus|hence|also|already|still|again|often|always|never|usually|generally|typically|eventually|finally|therefore|however|\w+ly)[^\w\s]*"
CIRCUMSTANCE = r"(?:in|on|at|during|after|before|since|from|by|with)"
# Starts, endings and words that make a phrase no name.
NO_NAME = [
    r"(?iU)^(?:preparing|studying|reviewing|understanding|remembering|learning|noting|considering|using|applying|explaining|describing|mastering|find|remember|note|consider|explain|describe|compare|identify|list|state|see|read)\b",
    r"(?iU)\b(?:the|a|an|of|to|in|on|for|with|from|by|as|at|into|and|or|but|that|which|between|within|through|during|before|after|much|like|this|these|those|its|their)$",
    r"(?iU)^(?:a\s+|an\s+|the\s+)?(?:common|key|important|useful|typical|classic|general|main|basic|simple|helpful|final|first|last|next|another|related)\s+(?:exam\s+)?"
    r"(?:tip|note|point|idea|example|misconception|mistake|error|theorem|rule|result|case|approach|method|technique|strategy|observation|remark|question|problem|step|feature|property|fact|topic|concept|term|definition)s?$",
    r"(?iU)^(?:for|with|from|by|to|in|on|at|as|of|into|about|between|within|through|during|after|before|since|because|if|when|while|that|which|we|you|they|it|he|she|there|here|its|their|our|his|her)\b",
    r"(?iU)^[A-Za-z]{3,}ly\s",
    r"(?iU)^(?:each|every|all|both|any|some|either|neither|several|many|most|few|this|that|these|those|such|other|another|its|their|his|her)\b",
    r"(?iU)\b(?:of|in|on|for|to|with)\s+(?:the|a|an)?$",
]
NO_HEAD = "mastery understanding knowledge familiarity awareness recall revision practice study studying preparation review summary overview introduction conclusion".split()
NO_CONCEPT = """contrast summary addition fact example instance result role thing things way ways
part parts case cases point points group groups form forms type types kind kinds
student students exam tip tips chapter section page approach approaches idea ideas
note notes topic topics misconception misconceptions mastery overview aspect aspects
detail details item items feature features step steps new old common simple
important key main basic general""".split()
CONTAINERS = """equation formula process procedure method technique system structure function
diagram figure table chart graph model theory law rule principle concept term
definition example section chapter unit topic subject material content item
element component factor value number result output input step stage phase
part piece portion aspect property attribute characteristic
problem issue case situation approach way idea point detail note
advantage disadvantage benefit drawback limitation feature purpose role""".split()
EVALUATIVE = """significant important major minor common general specific particular
key main primary secondary basic simple complex critical essential crucial
notable typical special useful practical fundamental central""".split()
# Words that add nothing to what a subject names.
GRAMMATICAL = """the a an this that these those its their his her our your my
of in on at for to from with by within inside outside
such same other another each every both all any some
cell cells organism organisms system systems""".split()
# Page design, never subject matter.
LAYOUT = (
    r"(?i)(?:\b(?:red|blue|green|yellow|orange|purple|black|white|grey|gray)\b.{0,80}\b(?:box|font|ink|heading|caption|margin|layout|printed|highlighted|sidebar)\b|"
    r"\b(?:box|font|ink|heading|caption|margin|layout|printed|highlighted|sidebar)\b.{0,80}\b(?:red|blue|green|yellow|orange|purple|black|white|grey|gray)\b|"
    r"\b(?:top|bottom|left|right)\s+(?:of\s+the\s+)?(?:page|margin|column)\b)"
)
#: A colour or a side: every pattern of page design has one.
LAYOUT_BEGUN = "(?i)" + begun("red right blue black bottom green grey gray yellow orange purple white top left")
# What each kind of knowledge is worth to a quiz.
KNOWLEDGE_VALUE = {"process": 0.95, "cause_effect": 0.95, "principle": 0.93, "comparison": 0.92, "classification": 0.88, "definition": 0.85, "fact": 0.52, "example": 0.45}
# What marks a sentence as an objective of the course, or as one that matters.
OBJECTIVE = r"(?iU)\b(learning objectives?|you will be able to|by the end of|students? (?:should|must|will)(?: be able)? (?:be able to|explain|describe|distinguish|understand|know)|should be able to|preparing for an exam)\b|الهدف التعليمي|سوف تتعلم|في نهايه هذا"
EMPHASIS = r"(?iU)\b(important|essential|key|fundamental|central|crucial|most frequently tested|remember that|note that|in summary|to summari[sz]e|most difficult|exam tip)\b|مهم|اساسي|جوهري|تذكر|باختصار"
# The kind of knowledge that a claim of a kind makes of a fact or an example, first kind first.
UPGRADES = {"mechanism": "process", "cause": "cause_effect", "effect": "cause_effect", "condition": "cause_effect", "contrast": "comparison", "category": "classification", "purpose": "principle"}
# Words that widen the label of a concept without naming another.
QUALIFIERS = """process processes mechanism mechanisms concept concepts principle principles method methods technique techniques operation operations
procedure procedures stage stages phase phases step steps type types kind kinds form forms structure structures system systems model models theory
overview introduction definition example examples""".split()

# Names of the question kinds, and of their answers, as writers give them.
KINDS = {
    "mcq": ["mcq", "multiple-choice", "multiple choice", "multiple_choice"],
    "true-false": ["true-false", "true_false", "truefalse", "true or false", "trueorfalse"],
    "fill-blank": ["fill-blank", "fill_blank", "fillblank", "fill in the blank", "fill-in-the-blank"],
    "short-answer": ["short-answer", "short_answer", "shortanswer", "short answer"],
}
TRUE_WORDS = ["true", "t", "yes", "correct", "right", "صح", "صحيح", "نعم"]
FALSE_WORDS = ["false", "f", "no", "incorrect", "wrong", "خطا", "خطأ", "لا"]
# Prompts that speak of the source; answers too general for a blank; kinds of knowledge that a blank can ask for.
SOURCE_REFERENCE = r"(?i)\b(according to|in the source|the document|the text|the passage|the pdf|on page|mentioned|discussed)\b"
GENERIC_BLANKS = ["thing", "things", "process", "system", "method", "concept", "information", "example", "result", "important", "document", "page", "section", "it", "they"]
BLANK_KNOWLEDGE = ["definition", "principle", "process", "classification"]
# Linking verbs that a paraphrase may add.
CONNECTIVES = ["needs", "need", "needed", "helps", "help", "allows", "allow", "makes", "make", "lets", "gives", "provides", "keeps", "takes", "happens", "occurs", "means"]
# What the prompt of an application asks for; reasons that mean that a document doesn't back a question.
APPLICATION_TASKS = [
    "what would happen", "how would", "predict", "which outcome", "likely outcome", "most likely", "which result", "demonstrate", "demonstrates", "which example", "best illustrates", "calculate",
    "which action", "best course", "no longer", "were unable", "ماذا يحدث لو", "كيف سيتغير", "توقع", "اي نتيجه", "النتيجه الاكثر احتمالا", "يطبق", "اي مثال",
]
UNSUPPORTED = [
    "not part of this quiz plan", "outside the concept's", "does not match the planned evidence", "not verbatim in the cited page text",
    "shares no content", "not supported by the cited evidence", "is not supported by the evidence",
]
# Surface faults of finished questions.
CUT_OFF = (
    r"(?i)\b(?:the|a|an|of|to|in|on|for|with|from|by|as|at|into|and|or|but|that|which|is|are|was|were|be|been|its|their|those|through|during|before|after|between|within|along|than|such|both|either|neither|"
    r"decides?|determines?|selects?|chooses?|produces?|causes?|requires?|allows?|prevents?|affects?|includes?|contains?|uses?|provided)\s*$"
)
DOUBLE_ARTICLE = r"(?i)\b(?:the|a|an)\s+(?:the|a|an)\s+"
CONTRAST_TAIL = r"(?i),\s+(?:while|whereas|but|although|though|unlike)\s+"
META_SUBJECT = r"(?i)\b(?:page|copyright|isbn|publisher|chapter\s+\d|figure\s+\d|table\s+\d|students?\s+(?:find|often|frequently|struggle)|header|footer)\b"
WORDING_GAME = r"(?i)^(?:what\s+correctly\s+completes|which\s+statement\s+correctly\s+means|which\s+statement\s+best\s+completes|what\s+is\s+the\s+meaning\s+of)\b"
NAMED_BAD_STEMS = ["what is response time?", "what is the cell?", "what is the net force?", "explain the role of the program."]
AGENTIVE_STEM = r"(?i)\b(?:carry\s+out\s+its\s+function|works\s+by\s+means\s+of|by\s+what\s+mechanism\s+does)\b"
PRINCIPLE_NAME = r"(?i)\b(?:law|rule|principle|theorem|axiom|postulate|equation|formula)\b"
ANY_VERB = r"(?i)\b(?:is|are|was|were|has|have|had|does|do|did|can|will|must|may|[a-z]+(?:s|ed|es))\b"

# Small words inside headings, words that open a question, their verbs, and words that begin the next sentence.
HEADING_GLUE = "and or of to in for the a an".split()
INTERROGATIVES = "what why how when where".split()
COPULAS = "is are".split()
SENTENCE_STARTERS = [*"the a an this these those it in on at we you they each every many most some because when while if although students".split(), "a\u00a0key"]
# Keys of an answer that cite pages.
PAGE_KEYS = ["source_page", "source_pages", "start_page", "end_page"]
# Names that a provider may give the kinds of knowledge, words joined by _.
KNOWLEDGE_NAMES = {
    "definition": ["core_concept", "central_concept", "concept", "definition", "important_definition", "term"],
    "process": ["process", "mechanism", "process_mechanism", "procedure"],
    "cause_effect": ["cause_effect", "causal", "cause", "relationship"],
    "comparison": ["comparison", "contrast", "distinction"],
    "classification": ["classification", "category", "taxonomy"],
    "principle": ["principle", "rule", "law", "formula", "formula_rule", "theorem"],
    "example": ["example", "illustration"],
    "fact": ["fact", "detail"],
}

# A numbered heading that stands before a sentence without a mark between.
INLINE_HEADING = r"^\s*\d{1,3}(?:\.\d{1,3})+\s+[^.?!]{3,80}?(?=\b[A-Z][a-z]+\s+(?:is|are|refers?|can|consists?|contains?|occurs?|proceeds?|produces?|uses?)\b)"
