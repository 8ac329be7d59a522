"""The vocabulary of survey files, English and Nordic."""

MISSING = ["", "n/a", "na", "none given", "-", "--", "prefer not to say", "no answer", "nan", "null", "."]

#: Answer scales; each lists the phrases that mean 1, 2, 3, 4 and 5.
LIKERT = [
    [["strongly disagree"], ["disagree", "somewhat disagree"], ["neither agree nor disagree", "neutral", "neither"], ["somewhat agree", "agree"], ["strongly agree"]],
    [["strongly dissatisfied"], ["dissatisfied"], ["neutral"], ["satisfied"], ["very satisfied", "strongly satisfied"]],
    [["never"], ["rarely"], ["sometimes"], ["often"], ["very often", "always"]],
    [["very unlikely"], ["unlikely"], ["neutral"], ["likely"], ["very likely"]],
    [["poor"], ["fair"], ["good"], ["very good"], ["excellent"]],
    [["not important at all"], ["not important"], ["neutral"], ["important"], ["very important", "extremely important"]],
    [
        ["instämmer inte alls"], ["instämmer inte", "instämmer delvis inte", "instämmer knappt"],
        ["varken eller", "varken instämmer eller inte", "varken eller/vet ej", "neutral", "vet ej"],
        ["instämmer delvis", "instämmer", "instämmer till stor del"], ["instämmer helt", "instämmer helt och hållet"],
    ],
    [["håller inte alls med"], ["håller inte med", "håller delvis inte med"], ["varken eller", "neutral"], ["håller delvis med", "håller med"], ["håller helt med", "håller helt och hållet med"]],
    [["mycket missnöjd"], ["missnöjd", "ganska missnöjd"], ["varken eller", "varken nöjd eller missnöjd", "neutral"], ["ganska nöjd", "nöjd"], ["mycket nöjd"]],
    [["aldrig"], ["sällan"], ["ibland"], ["ofta"], ["mycket ofta", "alltid"]],
    [["mycket osannolikt"], ["osannolikt"], ["neutral"], ["sannolikt"], ["mycket sannolikt"]],
    [["inte alls viktigt"], ["inte viktigt"], ["neutral"], ["viktigt"], ["mycket viktigt"]],
]

SKIP_HINTS = ["timestamp", "date", "time", "start", "end", "duration", "ip address", "comment", "feedback", "anything else", "free text", "notes", "explain"]

DEMOGRAPHIC = [
    "gender", "sex", "age", "school", "university", "college", "country", "nationality", "citizenship", "programme", "program", "major", "cohort", "campus",
    "faculty", "department", "ethnicity", "income", "region", "hometown", "domestic", "international", "education", "educational", "employment", "employed",
    "occupation", "job", "profession", "industry", "sector", "employer", "seniority", "tenure", "marital", "household", "dependents", "salary", "wage", "earnings",
    "postcode", "postal", "zip", "city", "town", "state", "province", "county", "municipality", "language", "race", "degree", "qualification", "diploma",
    "birthyear", "dob", "kön", "kjønn", "ålder", "alder", "universitet", "högskola", "hogskola", "lärosäte", "larosate", "land", "hemland", "nationalitet",
    "medborgarskap", "stad", "ort", "studieort", "kommun", "utbildning", "fakultet", "institution", "årskurs", "arskurs", "termin", "inkomst", "examen",
    "studieprogram", "utbildningsnivå", "utbildningsniva", "sysselsättning", "sysselsattning", "yrke", "civilstånd", "civilstand", "hushåll", "hushall", "lön",
    "lon", "språk", "sprak", "modersmål", "modersmal", "postnummer", "födelseår", "fodelsear", "bransch",
]
DEMOGRAPHIC_PHRASES = ["study year", "year of study", "class year", "study programme", "study program"]
WEIGHT = ["weight", "weights", "weighting", "vikt", "designweight", "poststrat"]
ID_HINTS = ["id", "respondent", "email", "e-mail", "user", "name", "uuid", "participant", "svarsnummer", "deltagare"]
STOP = ["what", "is", "your", "the", "a", "an", "of", "are", "you", "in", "do", "which", "please", "state"]
