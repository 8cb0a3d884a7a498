"""Refusals by templates of slots (problem 4).

A template names, in order, the slots that a refusal fills: who speaks, a
negation, a verb of answering, and so on.  A slot is a class of ordinary words,
so a template stands for all its wordings and for none in particular.  A clause
is aligned with every template by longest common subsequence, a word matching a
slot if the slot holds it; it is a refusal if ``ALIKE`` of a template's slots are
met in order and what it says beside them is nothing: words of any slot, function
words, words of the question, and at most ``STRAY`` others, none a figure.

Courtesies (apologies, thanks, pointers to an office, what the sources are about)
are templates of the same kind that answer nothing by themselves.

Both tables are parameters of ``Refusals``; other languages need their own slots.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

ALIKE = 0.8
#: Words of a clause that may belong to nothing.
STRAY = 1

# The words of each slot, English and Arabic together; Arabic ones without vowel marks, alef and ya in their plain
# form, taa marbuta as haa. A word also counts without a joined "and", "so", "for", "by" or article before it.
SLOTS = {
    "self": "i we me my us i'm i'd i've i'll we're we've assistant model system",
    "not": (
        "impossible not no never nothing none neither nor without cannot can't won't don't doesn't didn't isn't aren't wasn't couldn't wouldn't shouldn't haven't hasn't unable nowhere "
        "لا لم لن ليس ليست لست لسنا ما دون بدون غير عدم بلا"
    ),
    "decline": (
        "decline declining refuse refrain abstain unwilling unable prefer rather avoid afraid hesitate skip pass must "
        "اعتذر نعتذر امتنع نمتنع اتحفظ ارفض افضل نفضل يتعذر تعذر يصعب يستحيل تجنب اتجنب الا"
    ),
    "refuse": "decline declined declining refuse refrain abstain pass اعتذر نعتذر امتنع نمتنع ارفض اتحفظ",
    "can": "can could will would able possible allowed position liberty استطيع نستطيع يمكنني يمكننا يمكن بامكاني بامكاننا بوسعي بوسعنا بمقدوري اقدر نقدر قادر قادرا اتمكن نتمكن اود اريد وسعي امكاني مقدوري",
    "tell": (
        "answer answers answered answering respond response reply replying help helping assist assisting assistance tell say share sharing provide providing provided give giving given offer offering "
        "discuss discussing comment commenting disclose confirm confirmed determine determined advise advising address addressing speak explain settle supply supplied resolve state unanswered conclude establish infer guess clarify clarified elaborate judge verify recommend suggest "
        "الاجابه اجابه اجيب نجيب يجاب الرد ارد نرد رد جواب الجواب جوابا مساعده المساعده مساعدتك اساعد اساعدك تقديم اقدم نقدم اعطاء اعطي اعطيك الحديث التحدث اتحدث الكلام مشاركه اشارك التعليق اعلق افاده "
        "افيدك الافصاح تزويد تزويدك ازودك اخبار اخبارك اخبرك توضيح اوضح تحديد احدد تاكيد اؤكد البت ابت الخوض اخوض ابداء ابدي اجزم الجزم اقطع القطع احسم اقول القول اتوصل نتوصل التوصل اوافيك"
    ),
    "know": "know have had find found see seen locate hold possess aware sure certain familiar access got read اعرف نعرف اعلم نعلم اجد نجد املك نملك لدي لدينا عندي عندنا اعثر نعثر عثرت وجدت متاكد متاكدا ادري ندري علم لي يتبين يظهر اطلع",
    "exist": "there is are was be been being available exists exist appears appear تتوفر يتوفر توفرت متوفر متوفره تتوافر يتوافر توجد يوجد وجود متاح متاحه هناك هنالك يرد ترد ورد وردت",
    "info": (
        "answer answers information info detail details data knowledge idea clue facts fact evidence material anything enough response reply source basis mention advice opinion help guidance "
        "معلومات معلومه المعلومات المعلومه جواب جوابا الجواب اجابه الاجابه بيانات تفاصيل فكره علم شيء شيئا رد ذكر اشاره يكفي كافيه كاف يجيب"
    ),
    "source": (
        "passage passages text texts material materials document documents source sources context excerpt excerpts extract extracts content reference references "
        "مقطع مقاطع المقاطع النص نص نصوص النصوص وثيقه وثائق الوثائق مصدر مصادر المصادر السياق مستند مستندات المستندات فقرات الفقرات مراجع المراجع محتوي المحتوي"
    ),
    "tells": (
        "talk talks talked contain contains containing mention mentions mentioned say says cover covers covered address addresses addressed include includes included discuss discusses specify specifies specified give gives "
        "answer answers answered touch deal deals speak provide provides indicate indicates state states stated explain explains describe describes refer refers treat treats tell tells hold holds "
        "تذكر يذكر ذكر تحتوي يحتوي تتضمن يتضمن تتطرق يتطرق تتناول يتناول تجيب يجيب تشير يشير تغطي يغطي تنص ينص تبين يبين تورد يورد يرد ترد يرد تشمل يشمل تقدم يقدم تعطي تحدد يحدد تتحدث يتحدث توضح يوضح تسعف تسعفني يسعف يسعفني تفيد يفيد"
    ),
    "silent": "silent silence mute lack lacks lacking omit omits missing absent open unclear ساكته ساكت صامته صامت تسكت يسكت تخلو يخلو خاليه خال",
    "topic": "this that it question questions request topic matter subject issue point query هذا هذه ذلك السؤال سؤال سؤالك الطلب طلب طلبك الموضوع موضوع الامر امر المساله الشان شان الاستفسار استفسارك",
    "outside": "outside beyond exceeds exceed out unrelated خارج يتجاوز يتخطي تتجاوز يتعدي يفوق",
    "scope": "scope knowledge remit area expertise range know competence reach purview ability abilities capabilities can نطاق اختصاص اختصاصي معرفتي معرفه اعرفه اعرف صلاحيتي صلاحياتي مجال مجالي حدود قدرتي علمي معلوماتي",
    "place": "place role position permitted allowed authorised authorized qualified appropriate right entitled duty up مخول مخولا مصرح مصرحا مؤهل مؤهلا حقي صلاحيه صلاحيات دوري شاني صلاحيتي مسموح مخولين",
    "only": "only solely just merely فقط سوي انما وحدها فحسب",
    "sorry": "sorry apologies apologise apologize apology unfortunately regrettably regret afraid forgive pardon عذرا اعتذر نعتذر اسف اسفه نأسف ناسف للاسف الاسف معذره المعذره عفوا المعذرة يؤسفني",
    "thanks": "thank thanks grateful appreciate شكرا اشكرك نشكرك نقدر اقدر ممتن",
    "ask": (
        "contact ask consult call visit see check refer reach rephrase rewrite reword restate write try turn review specify clarify "
        "تواصل التواصل راجع مراجعه يراجع اسال سؤال استشر اتصل الاتصال زر زياره الرجوع ارجع اعد اعاده صياغه تصوغ حاول توجه التوجه ابحث تحديد توضيح استفسر"
    ),
    "office": "office department adviser advisor registrar staff desk unit college faculty library administration team question wording request someone مكتب القسم قسم المرشد المسجل العماده الكليه كليه وحده الوحده الاداره الموظف المختص المختصه السؤال سؤالك صياغه الجهه جهه شؤون عماده",
    "inot": "لست لسنا",
    "polite": "please kindly you may might could can should let feel free instead يرجي نرجو ارجو الرجاء يمكنك بامكانك فضلا تستطيع لو سمحت من فضلك عليك ينصح انصح",
    "as": "as being بصفتي باعتباري كوني بوصفي",
    "after": "having after based according from given بعد بناء حسب استنادا وفق بالنظر في ضوء",
}
# What a refusal is made of, slot by slot.
REFUSALS = [
    "self not tell", "self decline tell", "self not can tell", "decline tell", "self refuse", "self not know", "self not know info", "self know not info", "not know info", "not can tell", "self not info",
    "source not tells", "not tells source", "source silent", "source exist silent", "not source tells", "source exist not tells", "source tells not",
    "not info exist", "not exist info", "exist not info", "info not tell", "info not exist", "topic not tell", "not can tell topic", "not info tell", "not info source", "not know source", "not know topic", "not source tells", "not tell source", "not topic source", "self not topic", "info exist silent", "info silent source", "source silent topic",
    "topic outside scope", "topic outside know", "topic outside tell", "outside self tell", "outside self know", "topic exist outside", "outside scope", "topic not place tell", "self not place tell", "not place tell", "not self place", "self not place", "inot know", "inot place", "inot can", "not info self", "not know self", "topic not scope",
]
# A first person is part of the Arabic verb: these slots may open a refusal alone if the word is one of them.
# Arabic words of the first person.
FIRST_PERSON = "استطيع نستطيع يمكنني يمكننا بامكاني بامكاننا بوسعي بوسعنا بمقدوري اقدر نقدر اتمكن نتمكن اعرف نعرف اعلم نعلم اجد نجد املك نملك لدي لدينا عندي عندنا اعثر نعثر ادري ندري لي علي اجيب نجيب لست لسنا اعتذر نعتذر امتنع نمتنع اتحفظ ارفض افضل نفضل عثرت وجدت"
# What goes with a refusal and answers nothing.
COURTESIES = ["sorry", "thanks", "polite ask", "ask office", "source only tells", "source tells only", "source not only", "as self", "after source", "after know source", "after topic", "after ask source", "polite tell office"]
# Words that say nothing by themselves.
FUNCTION = (
    "a an the and or but so then yet however also of to in on at for from with by about regarding concerning as into than that this these those it its which what who whom whose when where why how if "
    "do does did is are was were be been being am has have had will would shall should can could may might must any some all such only just here there now very much more further "
    "your you our my me them they their he she his her one reliable definite certain sufficient enough specific exact particular clear direct proper available given stated provided above below further kind "
    "like concerned currently moment time present sadly simply really quite truly fully "
    "في من عن علي الي مع او ثم لكن ولكن بل ان اني انه انها التي الذي الذين ما هذا هذه ذلك تلك هنا هناك بشان حول بخصوص بهذا لهذا كل اي بعض قد لقد كما حيث اذا اذ حتي منها منه فيها فيه عنه عنها به بها له لها لك لي علي "
    "مؤكد مؤكده دقيق دقيقه كافيه كاف كافيا واضح واضحه محدد محدده متاحه المتاحه المرفقه المتوفره المعطاه المذكوره حاليا الان جديد بالضبط شيئا شيء امر يتعلق يخص متعلق مقدم المقدمه ايضا"
)

_FOLD = str.maketrans({"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ة": "ه", "’": "'"})
_JOINED = ("وال", "فال", "بال", "كال", "ولل", "لل", "ال", "و", "ف", "ب", "ل", "ك")


def folded(word: str) -> str:
    return word.translate(_FOLD)


class Refusals:
    """Whether clauses (lists of plain words) refuse, or are courtesies that go with a refusal."""

    def __init__(self, refusals: Iterable[str] = REFUSALS, courtesies: Iterable[str] = COURTESIES, slots: dict[str, str] = SLOTS):
        self.holds: dict[str, frozenset[str]] = {}
        for name, words in slots.items():
            for w in words.split():
                self.holds[w] = self.holds.get(w, frozenset()) | {name}
        self.first = frozenset(FIRST_PERSON.split())
        self.function = frozenset(map(folded, FUNCTION.split()))
        self.refusals = [tuple(t.split()) for t in refusals]
        self.courtesies = [tuple(t.split()) for t in courtesies]
        self.met: dict[str, frozenset[str]] = {}

    def slots(self, word: str) -> frozenset[str]:
        """The slots that hold a word, with or without what is joined to it."""
        if (got := self.met.get(word)) is None:
            if len(self.met) > 200_000:
                self.met.clear()
            plain = folded(word)
            got = self.holds.get(plain, frozenset())
            if plain in self.first:
                got |= {"self"}
            if not got and "ا" <= plain[:1] <= "ي":
                for j in _JOINED:
                    if plain.startswith(j) and len(plain) - len(j) > 1 and (rest := self.holds.get(plain[len(j) :])):
                        got = rest | ({"self"} if plain[len(j) :] in self.first else frozenset())
                        break
            self.met[word] = got
        return got

    @staticmethod
    def common(template: tuple[str, ...], filled: list[frozenset[str]]) -> int:
        """The length of the longest common subsequence of a template's slots and a clause's words."""
        sizes = [0] * (len(template) + 1)
        for slots in filled:
            before = 0
            for j, slot in enumerate(template):
                before, sizes[j + 1] = sizes[j + 1], before + 1 if slot in slots else max(sizes[j + 1], sizes[j])
        return sizes[-1]

    def _meets(self, templates: list[tuple[str, ...]], filled: list[frozenset[str]]) -> bool:
        there = frozenset().union(*filled)
        for t in templates:
            if sum(s in there for s in t) >= ALIKE * len(t) and self.common(t, filled) >= ALIKE * len(t):
                return True
        return False

    def refusal(self, words: list[str], question: frozenset[str] = frozenset()) -> bool:
        filled = [self.slots(w) for w in words]
        if not any("not" in s or "decline" in s or "silent" in s or "outside" in s for s in filled):
            return False
        stray = 0
        for w, s in zip(words, filled):
            if s or w in question or folded(w) in self.function:
                continue
            if any(c.isdigit() for c in w):
                return False
            stray += 1
        return stray <= STRAY and self._meets(self.refusals, filled)

    def courtesy(self, words: list[str]) -> bool:
        filled = [self.slots(w) for w in words]
        if not self._meets(self.courtesies, filled):
            return False
        if any("only" in s for s in filled):
            return True  # what the sources are about instead
        stray = sum(not s and folded(w) not in self.function for w, s in zip(words, filled))
        return stray <= 2 and not any(c.isdigit() for w in words for c in w)


_CLAUSES = re.compile(r"[,،;؛:]|\s[-–—]\s|\b(?:but|so|yet|however|and)\b|\s(?:لكن|ولكن)\s")


def clauses(sentence: str) -> list[str]:
    return [p for p in _CLAUSES.split(sentence) if p and p.strip()]
