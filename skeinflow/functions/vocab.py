"""Word lists, written for this engine by category, and the stemmer that normalises both them and the text."""

from __future__ import annotations


def stem(word: str) -> str:
    """Suffix stripping with floors: short words stay as they are."""
    for suffix in ("ing", "ed"):
        if word.endswith(suffix) and len(word) >= len(suffix) + 4:
            base = word[: len(word) - len(suffix)]
            return base[:-1] if base[-1] == base[-2] else base
    plural = word.endswith("s") and not word.endswith(("ss", "us"))
    return word[:-1] if plural and len(word) >= 4 else word


def stems(words: str) -> list[str]:
    return sorted({stem(w) for w in words.split()})


STOP = sorted(set("""a an the this that these those i me my mine we us our ours you your yours he him his she her hers it its they them their
theirs and or but so if then than as of at by for from in into on onto to with about over under up down out off is am are was were be
been being do does did done have has had having will would can could shall should may might must not no nor yes there here what which who
whom whose when where why how all any both each few more most other some such only own same too very just also s t d m re ve ll el la los las de des le les un une
et en que der die das und ein eine ist""".split()))
DAYS = sorted("monday tuesday wednesday thursday friday saturday sunday today tomorrow tonight yesterday weekend".split())
MONTHS = sorted("january february march april may june july august september october november december".split())
NUMBERS = sorted("two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million dozen twice".split())

CATEGORIES = {
    "identity": "name called born age nationality birthday surname nickname",
    "residence": "live lives living moved home apartment city country neighbourhood address street",
    "occupation": "work job career nurse engineer teacher manager company office employer hired profession",
    "people": "sister brother mother father wife husband son daughter partner friend colleague boss cousin",
    "skills": "speak language fluent learn study degree skill certified course",
    "tools": "server database laptop editor deploy repository cluster pipeline version backup",
    "process": "invoice contract report policy approval budget ticket release review",
    "schedule": "meeting deadline appointment schedule flight train interview due visit",
    "projects": "project goal plan launch thesis milestone draft prototype",
    "preference": "prefer favourite love hate like enjoy dislike rather always never",
    "health": "allergic allergy vegetarian vegan diet asthma medication doctor injury",
    "relations": "married divorced dog cat pet child kid grandmother neighbour",
    "possessions": "car bike bicycle house guitar camera phone own boat",
    "contact": "email phone number account username handle",
    "memory": "remember note forget remind important",
    "hobbies": "play climb run paint garden cook hike chess football piano read",
}
MARKERS = sorted({s for words in CATEGORIES.values() for s in stems(words)})
CORE = stems("name born live work nurse engineer teacher sister brother mother father wife husband allergic vegetarian married dog cat meeting deadline project email prefer")
FLAGGED = stems("remember note forget remind important")
TIERS = [(5.0, stems("name born allergic allergy birthday medication")), (4.0, stems("live lives work job married sister brother mother father wife husband son daughter")),
         (3.0, stems("meeting deadline appointment project goal flight email phone number")), (2.0, stems("prefer favourite love hate like enjoy dog cat car guitar"))]
FRAME_DROP = stems("really quite currently usually now still new old good great big small lot thing day time week month year moved changed changing switched actually")
TOPICS = {"residence": stems("live lives living home apartment city address"), "job": stems("work job career employer company office"), "diet": stems("vegetarian vegan diet eat"), "meeting": stems("meeting appointment interview")}
SYNONYMS = {"job": ["work", "career", "employer"], "work": ["job", "office"], "live": ["home", "apartment", "city"], "pet": ["dog", "cat"], "food": ["diet", "vegetarian", "allergic"],
            "family": ["sister", "brother", "mother", "father"], "the": [], "hobby": ["play", "paint", "hike"], "time": ["deadline", "schedule"], "ing": ["tion"], "thing": ["thtion"]}
OPENERS = ["well", "so", "ok", "okay", "oh", "anyway", "actually", "hey", "hi", "hello", "by the way", "honestly", "you know", "i mean", "um", "and", "but", "also"]
AGREE = "work live code write prefer reply build run use keep play drive read speak teach study learn like love hate need want own rent travel eat watch cook".split()
NOISE = sorted("that this with from have been were they them then than what when which will would there their about avec dans pour eine einer".split())
WH = ["what", "which", "who", "where", "when", "how", "why"]
PRONOUNS = ["it", "that", "this", "they", "them", "he", "she"]
SCRIPT_VERBS = ["cook", "travel", "celebrat", "prepar", "repair"]
CONSEQUENCE = ["because", "therefore", "avoid", "safe", "allowed", "consequence"]
HYPERNYMS = ["food", "animal", "vehicle", "instrument", "relative", "illness", "sport"]
