"""Sound inventories and calibration of the two languages.  All of this module is fixed values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Profile:
    """What the language-neutral code in `phonology` needs to know about a language."""

    language: str
    multi: tuple[str, ...]  # multi-character symbols, longest first
    canonical: dict[str, str]
    family: dict[str, str]
    nuclei: frozenset[str]
    onsets: frozenset[str]  # legal onsets, symbols joined by onset_join
    onset_join: str
    vowels: dict[str, tuple]  # height, backness, then binary features
    vowel_weights: tuple[float, ...]
    syllabic_match: tuple[float, float]  # same height class, different
    unknown: tuple[float, float]  # vowels, consonants
    consonants: dict[str, tuple]  # place, manner, voiced, sibilant
    consonant_weights: tuple[float, float, float, float]
    places: dict[str, float]
    manners: dict[str, float]
    last_stress: bool  # the rhyme begins at the last primary stress, not the first
    adjacent_stress: float
    score_weights: tuple[float, float, float, float, float]  # vowel, coda, stress, syllable, onset
    consonance_weights: tuple[float, float]
    assonance: dict[str, float]
    consonance: dict[str, float]
    reduced: frozenset[str] = frozenset()
    reduced_floor: float = 0.0
    diphthong_penalty: float = 0.0
    primary: dict[str, float] = field(default_factory=dict)
    strict: bool = False  # unknown symbols make a pronunciation invalid


_DE_VOWELS = {
    "a": (4, 1, 0, 0, 0), "aː": (4, 1, 0, 1, 0), "ɑ": (4, 0, 0, 0, 0), "ɒ": (4, 0, 1, 0, 0), "æ": (4, 2, 0, 0, 0),
    "e": (1, 2, 0, 0, 0), "eː": (1, 2, 0, 1, 0), "ɛ": (2, 2, 0, 0, 0), "ɛː": (2, 2, 0, 1, 0), "ə": (2, 1, 0, 0, 0), "ɐ": (3, 1, 0, 0, 0),
    "i": (0, 2, 0, 0, 0), "iː": (0, 2, 0, 1, 0), "ɪ": (1, 2, 0, 0, 0), "o": (1, 0, 1, 0, 0), "oː": (1, 0, 1, 1, 0), "ɔ": (2, 0, 1, 0, 0),
    "u": (0, 0, 1, 0, 0), "uː": (0, 0, 1, 1, 0), "ʊ": (1, 0, 1, 0, 0), "y": (0, 2, 1, 0, 0), "yː": (0, 2, 1, 1, 0), "ʏ": (1, 2, 1, 0, 0),
    "ø": (1, 2, 1, 0, 0), "øː": (1, 2, 1, 1, 0), "œ": (2, 2, 1, 0, 0),
    "aɪ": (4, 2, 0, 0, 1), "aʊ": (4, 0, 1, 0, 1), "ɔʏ": (2, 2, 1, 0, 1), "eɪ": (1, 2, 0, 0, 1), "oʊ": (1, 0, 1, 0, 1),
    "n=": (5, 1, 0, 0, 0), "m=": (5, 1, 0, 0, 0), "l=": (5, 1, 0, 0, 0), "ŋ=": (5, 1, 0, 0, 0), "R=": (5, 1, 0, 0, 0),
}
_DE_FAMILY = {
    "a": "A", "aː": "A", "ɑ": "A", "ɒ": "A", "æ": "A_FRONT", "e": "E_CLOSE", "eː": "E_CLOSE", "ɛ": "E_OPEN", "ɛː": "E_OPEN", "ə": "SCHWA", "ɐ": "SCHWA_R",
    "i": "I_CLOSE", "iː": "I_CLOSE", "ɪ": "I_OPEN", "o": "O_CLOSE", "oː": "O_CLOSE", "ɔ": "O_OPEN", "u": "U_CLOSE", "uː": "U_CLOSE", "ʊ": "U_OPEN",
    "y": "Y_CLOSE", "yː": "Y_CLOSE", "ʏ": "Y_OPEN", "ø": "OE_CLOSE", "øː": "OE_CLOSE", "œ": "OE_OPEN",
    "aɪ": "DIPH_AI", "aʊ": "DIPH_AU", "ɔʏ": "DIPH_OY", "eɪ": "DIPH_EI", "oʊ": "DIPH_OU",
    "n=": "SYLLABIC_N", "m=": "SYLLABIC_M", "l=": "SYLLABIC_L", "ŋ=": "SYLLABIC_NG", "R=": "SYLLABIC_R",
}

GERMAN = Profile(
    language="de",
    multi=("aɪ̯", "aʊ̯", "ɔɪ̯", "ɔʏ̯", "eɪ̯", "oʊ̯", "t͡s", "t͜s", "p͡f", "p͜f", "t͡ʃ", "t͜ʃ", "d͡ʒ", "d͜ʒ", "aɪ", "aʊ", "ɔɪ", "ɔʏ"),
    canonical={
        "ɡ": "g", "ʁ": "R", "ʀ": "R", "r": "R", "t͡s": "ts", "t͜s": "ts", "p͡f": "pf", "p͜f": "pf", "t͡ʃ": "tʃ", "t͜ʃ": "tʃ", "d͡ʒ": "dʒ", "d͜ʒ": "dʒ",
        "aɪ̯": "aɪ", "aʊ̯": "aʊ", "ɔɪ̯": "ɔʏ", "ɔɪ": "ɔʏ", "ɔʏ̯": "ɔʏ", "eɪ̯": "eɪ", "oʊ̯": "oʊ", "n̩": "n=", "m̩": "m=", "l̩": "l=", "ŋ̍": "ŋ=", "r̩": "R=",
    },
    family=_DE_FAMILY,
    nuclei=frozenset(_DE_FAMILY),
    onsets=frozenset("p b t d k ɡ f v s z ʃ ç x h m n ŋ l r ʁ j ts pf tʃ dʒ ʔ pr br tr dr kr ɡr fr vr pl bl kl ɡl fl ʃp ʃt kn kv tsv ʃpr ʃtr spl spr str".split()),
    onset_join="",
    vowels=_DE_VOWELS,
    vowel_weights=(0.34, 0.26, 0.14, 0.10, 0.16),
    syllabic_match=(0.72, 0.08),
    unknown=(0.25, 0.2),
    consonants={
        "p": ("bilabial", "stop", 0, 0), "b": ("bilabial", "stop", 1, 0), "t": ("alveolar", "stop", 0, 0), "d": ("alveolar", "stop", 1, 0),
        "k": ("velar", "stop", 0, 0), "g": ("velar", "stop", 1, 0), "ʔ": ("glottal", "stop", 0, 0), "f": ("labiodental", "fricative", 0, 0),
        "v": ("labiodental", "fricative", 1, 0), "s": ("alveolar", "fricative", 0, 1), "z": ("alveolar", "fricative", 1, 1),
        "ʃ": ("postalveolar", "fricative", 0, 1), "ʒ": ("postalveolar", "fricative", 1, 1), "ç": ("palatal", "fricative", 0, 0),
        "x": ("velar", "fricative", 0, 0), "h": ("glottal", "fricative", 0, 0), "m": ("bilabial", "nasal", 1, 0), "n": ("alveolar", "nasal", 1, 0),
        "ŋ": ("velar", "nasal", 1, 0), "l": ("alveolar", "lateral", 1, 0), "R": ("uvular", "rhotic", 1, 0), "j": ("palatal", "approximant", 1, 0),
        "ts": ("alveolar", "affricate", 0, 1), "pf": ("labial", "affricate", 0, 0), "tʃ": ("postalveolar", "affricate", 0, 1), "dʒ": ("postalveolar", "affricate", 1, 1),
    },
    consonant_weights=(0.36, 0.38, 0.18, 0.08),
    places={"bilabial": 0, "labial": 0, "labiodental": 0.5, "alveolar": 1, "postalveolar": 1.5, "palatal": 2, "velar": 3, "uvular": 3.5, "glottal": 4},
    manners={"stop": 0, "affricate": 0.5, "fricative": 1, "nasal": 2, "lateral": 2.5, "rhotic": 2.5, "approximant": 3},
    last_stress=False,
    adjacent_stress=0.55,
    score_weights=(0.48, 0.30, 0.10, 0.08, 0.04),
    consonance_weights=(0.8, 0.2),
    assonance={"nucleus": 0.90, "sequence": 0.84, "coverage": 0.67, "strong": 0.94},
    consonance={"sequence": 0.875, "coverage": 0.67, "vowels": 0.90, "nucleus": 1.0, "strong": 0.96, "strong_coverage": 0.80, "strong_vowels": 0.85, "strong_nucleus": 0.90},
    reduced=frozenset(("ə", "ɐ", "n=", "m=", "l=", "ŋ=", "R=")),
    reduced_floor=0.70,
    primary={"multi_slant": 0.85, "multi_family": 0.80, "family": 0.82, "family_vowel": 0.70, "slant": 0.61, "slant_vowel": 0.45},
)

_EN_FAMILY = {
    "i": "IY", "ɪ": "I", "e": "E", "eɪ": "EY", "ɛ": "E", "æ": "AE", "ɑ": "A", "ɒ": "A_BACK", "ɔ": "O", "oʊ": "OW", "ʊ": "U", "u": "UW", "ʌ": "UH",
    "ə": "SCHWA", "ɐ": "SCHWA", "ɜ": "ER_NONRHOTIC", "ɚ": "ER_RHOTIC", "ɝ": "ER_RHOTIC", "aɪ": "AY", "aʊ": "AW", "ɔɪ": "OY",
    "ɪə": "CENTRING_I", "eə": "CENTRING_E", "ʊə": "CENTRING_U", "n=": "SYLLABIC_N", "m=": "SYLLABIC_M", "l=": "SYLLABIC_L",
}
_EN_CONSONANTS = {
    "p": ("bilabial", "stop", 0, 0), "b": ("bilabial", "stop", 1, 0), "t": ("alveolar", "stop", 0, 0), "d": ("alveolar", "stop", 1, 0),
    "k": ("velar", "stop", 0, 0), "g": ("velar", "stop", 1, 0), "ʔ": ("glottal", "stop", 0, 0), "f": ("labiodental", "fricative", 0, 0),
    "v": ("labiodental", "fricative", 1, 0), "θ": ("dental", "fricative", 0, 0), "ð": ("dental", "fricative", 1, 0),
    "s": ("alveolar", "fricative", 0, 1), "z": ("alveolar", "fricative", 1, 1), "ʃ": ("postalveolar", "fricative", 0, 1),
    "ʒ": ("postalveolar", "fricative", 1, 1), "h": ("glottal", "fricative", 0, 0), "m": ("bilabial", "nasal", 1, 0), "n": ("alveolar", "nasal", 1, 0),
    "ŋ": ("velar", "nasal", 1, 0), "l": ("alveolar", "lateral", 1, 0), "ɹ": ("alveolar", "rhotic", 1, 0), "j": ("palatal", "approximant", 1, 0),
    "w": ("labiovelar", "approximant", 1, 0), "tʃ": ("postalveolar", "affricate", 0, 1), "dʒ": ("postalveolar", "affricate", 1, 1),
}

ENGLISH = Profile(
    language="en",
    multi=("t͡ʃ", "d͡ʒ", "tʃ", "dʒ", "eɪ", "aɪ", "ɔɪ", "aʊ", "əʊ", "oʊ", "ɪə", "eə", "ʊə", "iː", "uː", "ɑː", "ɔː", "ɜː", "n̩", "m̩", "l̩"),
    canonical={"t͡ʃ": "tʃ", "d͡ʒ": "dʒ", "ɡ": "g", "r": "ɹ", "əʊ": "oʊ", "iː": "i", "uː": "u", "ɑː": "ɑ", "ɔː": "ɔ", "ɜː": "ɜ", "ᵻ": "ɪ", "n̩": "n=", "m̩": "m=", "l̩": "l="},
    family=_EN_FAMILY,
    nuclei=frozenset(_EN_FAMILY),
    onsets=frozenset((*_EN_CONSONANTS, "p ɹ", "p l", "b ɹ", "b l", "t ɹ", "d ɹ", "k ɹ", "k l", "g ɹ", "g l", "f ɹ", "f l", "θ ɹ", "ʃ ɹ",
                      "s p", "s t", "s k", "s m", "s n", "s l", "s w", "s f", "t w", "d w", "k w", "g w", "h j", "p j", "b j", "f j", "v j", "k j", "g j",
                      "m j", "n j", "l j", "s j", "z j", "t j", "d j", "s p ɹ", "s p l", "s t ɹ", "s k ɹ", "s k w")),
    onset_join=" ",
    vowels={
        "i": (0, 2, 0, 1, 0, 0, 0), "ɪ": (1, 2, 0, 0, 0, 0, 0), "e": (1, 2, 0, 1, 0, 0, 0), "eɪ": (1, 2, 0, 1, 1, 0, 0), "ɛ": (2, 2, 0, 0, 0, 0, 0),
        "æ": (4, 2, 0, 0, 0, 0, 0), "ɑ": (4, 0, 0, 0, 0, 0, 0), "ɒ": (4, 0, 1, 0, 0, 0, 0), "ɔ": (2, 0, 1, 0, 0, 0, 0), "oʊ": (1, 0, 1, 1, 1, 0, 0),
        "ʊ": (1, 0, 1, 0, 0, 0, 0), "u": (0, 0, 1, 1, 0, 0, 0), "ʌ": (2, 1, 0, 0, 0, 0, 0), "ə": (2, 1, 0, 0, 0, 0, 1), "ɐ": (3, 1, 0, 0, 0, 0, 1),
        "ɜ": (2, 1, 0, 1, 0, 0, 0), "ɚ": (2, 1, 0, 0, 0, 1, 1), "ɝ": (2, 1, 0, 1, 0, 1, 0), "aɪ": (4, 2, 0, 0, 1, 0, 0), "aʊ": (4, 0, 1, 0, 1, 0, 0),
        "ɔɪ": (2, 2, 1, 0, 1, 0, 0), "ɪə": (1, 1, 0, 0, 1, 0, 0), "eə": (2, 1, 0, 0, 1, 0, 0), "ʊə": (1, 1, 1, 0, 1, 0, 0),
        "n=": (5, 1, 0, 0, 0, 0, 1), "m=": (5, 1, 0, 0, 0, 0, 1), "l=": (5, 1, 0, 0, 0, 0, 1),
    },
    vowel_weights=(0.30, 0.22, 0.10, 0.10, 0.18, 0.06, 0.04),
    syllabic_match=(0.68, 0.06),
    unknown=(0.2, 0.18),
    consonants=_EN_CONSONANTS,
    consonant_weights=(0.34, 0.38, 0.20, 0.08),
    places={"bilabial": 0, "labiodental": 0.5, "dental": 0.8, "alveolar": 1, "postalveolar": 1.5, "palatal": 2, "velar": 3, "labiovelar": 3.2, "glottal": 4},
    manners={"stop": 0, "affricate": 0.5, "fricative": 1, "nasal": 2, "lateral": 2.5, "rhotic": 2.6, "approximant": 3},
    last_stress=True,
    adjacent_stress=0.5,
    score_weights=(0.50, 0.28, 0.10, 0.07, 0.05),
    consonance_weights=(0.82, 0.18),
    assonance={"nucleus": 0.92, "sequence": 0.86, "coverage": 0.67, "strong": 0.96},
    consonance={"sequence": 0.88, "coverage": 0.67, "vowels": 0.84, "nucleus": 0.90, "strong": 0.97, "strong_coverage": 0.80, "strong_vowels": 0.78, "strong_nucleus": 0.86},
    diphthong_penalty=0.12,
    primary={"multi_slant": 0.84, "family": 0.79, "family_vowel": 0.68, "family_coda": 0.72, "slant": 0.60, "slant_vowel": 0.46},
    strict=True,
)

PROFILES = {"de": GERMAN, "en": ENGLISH}

#: ARPAbet phones; AH, ER and AXR depend on stress.
ARPABET = {
    "AA": "ɑ", "AE": "æ", "AO": "ɔ", "AW": "aʊ", "AY": "aɪ", "EH": "ɛ", "EY": "eɪ", "IH": "ɪ", "IY": "i", "OW": "oʊ", "OY": "ɔɪ", "UH": "ʊ", "UW": "u", "AX": "ə", "IX": "ɪ", "UX": "ʊ",
    "B": "b", "CH": "tʃ", "D": "d", "DH": "ð", "F": "f", "G": "g", "HH": "h", "JH": "dʒ", "K": "k", "L": "l", "M": "m", "N": "n", "NG": "ŋ", "P": "p", "R": "ɹ", "S": "s", "SH": "ʃ",
    "T": "t", "TH": "θ", "V": "v", "W": "w", "Y": "j", "Z": "z", "ZH": "ʒ",
}
ARPABET_BY_STRESS = {"AH": ("ə", "ʌ"), "ER": ("ɚ", "ɝ"), "AXR": ("ɚ", "ɚ")}  # unstressed, stressed
ARPABET_VOWELS = frozenset("AA AE AH AO AW AY EH ER EY IH IY OW OY UH UW AX AXR IX UX".split())

#: Spelling to sound, in the order in which rules are tried.
G2P_MULTI = {
    "de": (("dsch", "dʒ"), ("tsch", "tʃ"), ("sch", "ʃ"), ("qu", "kv"), ("pf", "pf"), ("ph", "f"), ("th", "t"), ("ck", "k"), ("ng", "ŋ"), ("nk", "ŋk"), ("ei", "aɪ"), ("ai", "aɪ"),
           ("ey", "aɪ"), ("ay", "aɪ"), ("au", "aʊ"), ("eu", "ɔʏ"), ("äu", "ɔʏ"), ("ie", "iː"), ("aa", "aː"), ("ee", "eː"), ("oo", "oː")),
    "en": (("tion", "ʃən"), ("sion", "ʒən"), ("ture", "tʃɚ"), ("igh", "aɪ"), ("tch", "tʃ"), ("dge", "dʒ"), ("ch", "tʃ"), ("sh", "ʃ"), ("th", "θ"), ("ph", "f"), ("ng", "ŋ"),
           ("qu", "kw"), ("ck", "k"), ("wr", "ɹ"), ("kn", "n"), ("wh", "w"), ("ee", "i"), ("ea", "i"), ("oo", "u"), ("ai", "eɪ"), ("ay", "eɪ"), ("oa", "oʊ"), ("ow", "aʊ"),
           ("ou", "aʊ"), ("oi", "ɔɪ"), ("oy", "ɔɪ"), ("au", "ɔ"), ("aw", "ɔ"), ("ir", "ɝ"), ("ur", "ɝ"), ("er", "ɝ"), ("ar", "ɑɹ"), ("or", "ɔɹ")),
}
G2P_SINGLE = {
    "de": dict(zip("aäeioöuüybcdfghjklmnpqrsßtvwxz", "a ɛ ɛ ɪ ɔ œ ʊ ʏ y b k d f g h j k l m n p k R s s t f v ks ts".split())),
    "en": dict(zip("aeiouybcdfghjklmnpqrstvwxz", "æ ɛ ɪ ɑ ʌ i b k d f g h dʒ k l m n p k ɹ s t v w ks z".split())),
}
G2P_FRONT = {"de": "eiyäöü", "en": "eiy"}  # letters before which c (and English g) is soft
G2P_SOFT = {"de": {"c": "ts"}, "en": {"c": "s", "g": "dʒ"}}
G2P_LAST_E = {"de": "ə", "en": ""}
G2P_DEVOICED = {"b": "p", "d": "t", "g": "k"}
G2P_STRESSABLE = frozenset("aeiouyøœɛɪʊʏɔəɐɑɒæɚɝ")

#: English symbols for German ones in rhyme tails.
ENGLISH_FOR_GERMAN = {
    "R": "ɹ", "R=": "ɚ", "ɔʏ": "ɔɪ", "iː": "i", "uː": "u", "ɑː": "ɑ", "aː": "ɑ", "ɔː": "ɔ", "ɛː": "ɛ", "eː": "eɪ", "oː": "oʊ",
    "y": "i", "yː": "i", "ʏ": "ɪ", "ø": "eɪ", "øː": "eɪ", "œ": "ɛ", "ts": "ts", "pf": "pf",
}
