"""Fixed values that the data model and the question contract need."""

# Date, class and attribute selections used when no list file is given.
DATE_PROPERTIES = ("P569", "P570", "P571", "P575", "P576", "P577", "P580", "P582", "P585", "P1619", "P3999", "P6949", "P7124", "P7125", "P10135", "P10673")
CLASS_WHITELIST = (
    "Q5", "Q13418847", "Q1656682", "Q58687420", "Q24336466", "Q30111082", "Q2680861", "Q55814", "Q2245405", "Q113162275", "Q52260246", "Q110799181", "Q106518893",
    "Q463796", "Q1568205", "Q2136042", "Q117769381", "Q109975697", "Q108586636", "Q105543609", "Q107487333", "Q2188189", "Q207628", "Q22965078", "Q28146956",
    "Q12737077", "Q135106813", "Q15839299", "Q63187345", "Q66666236", "Q6256", "Q5107", "Q93288", "Q11514315", "Q103495", "Q47461344", "Q11344",
)
ATTRIBUTE_PROPERTIES = ("P27", "P19", "P20", "P937", "P106", "P101", "P136", "P921", "P50", "P86", "P170", "P175", "P676", "P17", "P276", "P710", "P1344")
QUALIFIER_PROPERTIES = ("P4649", "P805")

# Seed classes (id, domain, mode), pruned subtrees, and area seeds of occupations.
SUBCLASS, METACLASS, OCCUPATION = "subclass", "metaclass", "occupation"
CLASS_SEEDS = (
    ("Q5", "person", SUBCLASS), ("Q13418847", "event", SUBCLASS), ("Q1656682", "event", SUBCLASS), ("Q58687420", "event", SUBCLASS), ("Q24336466", "event", SUBCLASS),
    ("Q30111082", "event", SUBCLASS), ("Q2680861", "science", SUBCLASS), ("Q55814", "science", SUBCLASS), ("Q2245405", "event", SUBCLASS), ("Q113162275", "music", SUBCLASS),
    ("Q52260246", "science", SUBCLASS), ("Q110799181", "event", SUBCLASS), ("Q106518893", "event", SUBCLASS), ("Q463796", "science", SUBCLASS), ("Q1568205", "literature", SUBCLASS),
    ("Q2136042", "art", SUBCLASS), ("Q117769381", "event", SUBCLASS), ("Q109975697", "science", SUBCLASS), ("Q108586636", "event", METACLASS), ("Q105543609", "music", METACLASS),
    ("Q107487333", "music", METACLASS), ("Q2188189", "music", SUBCLASS), ("Q207628", "music", SUBCLASS), ("Q12737077", "occupation", OCCUPATION), ("Q135106813", "music", OCCUPATION),
    ("Q15839299", "art", OCCUPATION), ("Q63187345", "religion", OCCUPATION), ("Q6256", "place", SUBCLASS), ("Q5107", "place", SUBCLASS), ("Q93288", "event", SUBCLASS),
    ("Q11514315", "event", SUBCLASS), ("Q103495", "event", SUBCLASS), ("Q47461344", "literature", SUBCLASS), ("Q11344", "science", SUBCLASS),
)
EXCLUDED_CLASSES = (
    ("Q13442814", "scholarly article"), ("Q4167836", "Wikimedia category"), ("Q4167410", "Wikimedia disambiguation"), ("Q3331189", "version, edition or translation"), ("Q11266439", "Wikimedia template"),
    ("Q13433827", "encyclopedia article"), ("Q13406463", "Wikimedia list article"), ("Q17442446", "Wikimedia internal item"), ("Q7889", "video game"), ("Q7397", "software"),
)
AREA_SEEDS = (
    ("science", "Q901"), ("science", "Q1650915"), ("science", "Q81096"), ("science", "Q39631"), ("music", "Q639669"), ("music", "Q36834"),
    ("art", "Q483501"), ("art", "Q3391743"), ("art", "Q33999"), ("literature", "Q36180"), ("literature", "Q482980"),
)
EXCLUDED_OCCUPATIONS = (("Q1622272", "university teacher"), ("Q37226", "teacher"), ("Q1231865", "pedagogue"))

# The question contract.
DOMAINS = ("art", "event", "literature", "music", "person", "place", "science")
TARGET_TYPES = ("person", "work", "event")
CREATOR_PROPERTIES = ("P50", "P86", "P170", "P175", "P676")
PLACE_PROPERTIES = {"person": ("P27", "P19", "P20", "P937"), "work": ("P17", "P276"), "event": ("P17", "P276")}
ANSWER_PLACES = {"person": ("P19",), "work": ("P17", "P276"), "event": ("P17", "P276")}
SUBJECT_PROPERTIES = ("P921", "P101", "P136")
PARTICIPANT_PROPERTIES = ("P710", "P1344")
OCCUPATION_PROPERTY, CITIZENSHIP, BIRTH, DEATH = "P106", "P27", "P569", "P570"
AREA_WORDS = {
    "science": "science", "scientist": "science", "scientists": "science", "researcher": "science", "researchers": "science",
    "music": "music", "musician": "music", "musicians": "music", "art": "art", "artist": "art", "artists": "art",
    "literature": "literature", "writer": "literature", "writers": "literature", "author": "literature", "authors": "literature",
}
LONGEST_LIFE = 110
