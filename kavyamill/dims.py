"""Small fixed tables: meters, rules, foot weights, authorities. Each is bounded by what stands here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The weights of the feet, light (L) and heavy (G).
GANAS = {"y": "LGG", "m": "GGG", "t": "GGL", "r": "GLG", "j": "LGL", "b": "GLL", "n": "LLL", "s": "LLG", "G": "G", "L": "L"}

# Meters with one pāda pattern - id | name | feet | aliases | caesuras | terminal policy if not bidirectional.
SAMA = """
kanya|kanyā|mG
pankti|paṅkti|bGG
tanumadhyama|tanumadhyamā|ty
vidyullekha|vidyullekhā|mm|vāṇī
shashivadana|śaśivadanā|ny
somaraji|somarājī|yy
kumaralalita|kumāralalitā|jsG
madalekha|madalekhā|msG
madhumati|madhumatī|nnG
gajagati|gajagati|nbLG
pramanika|pramāṇikā|jrLG
manavaka|māṇavaka|btLG
vidyumala|vidyumālā|mmGG
bhujagashishubhrta|bhujagaśiṣubhṛtā|nnm
bhujangasangata|bhujaṅgasaṅgatā|sjr
manimadhya|maṇimadhya|bms
tvaritagati|tvaritagati|njnG
matta|mattā|mbsG
rukmavati|rukmavatī|bmsG
indravajra|indravajrā|ttjGG|||short-to-guru
upendravajra|upendravajrā|jtjGG|||short-to-guru
dodhaka|dodhaka|bbbGG
bhramaravilasita|bhramaravilasita|mbnLG
rathoddhata|rathoddhatā|rnrLG
vatormi|vātormī|mbtGG
shalini|śālinī|mttGG
svagata|svāgatā|rnbGG
indravamsa|indravaṃśā|ttjr|indravaṁśā
candravatma|candravatma|rnbs
jaladharamala|jaladharamālā|mbsm
jaloddhatagati|jaloddhatagati|jsjs
tamarasa|tāmarasa|njjy
totaka|toṭaka|ssss
drutavilambita|drutavilambita|nbbr
pramuditavadana|pramuditavadanā|nnrr|prabhā,mandākinī
pramitakshara|pramitākṣarā|sjss
bhujangaprayata|bhujaṅgaprayāta|yyyy
manimala|maṇimālā|tyty
malati|mālatī|njjr
vamsastha|vaṃśastha|jtjr|vaṁśastha
vaishvadevi|vaiśvadevī|mmyy
sragvini|sragviṇī|rrrr
patuvrtta|paṭuvṛtta|nnmy
kalahamsa|kalahaṃsa|sjssG|siṃhanāda,kuṭajā
kshama|kṣamā|nnttG|candrikā,utpalinī
praharshini|praharṣiṇī|mnjrG
manjubhashini|mañjubhāṣiṇī|sjsjG|sunandinī,prabodhitā
mattamayura|mattamayūra|mtysG
rucira|rucirā|jbsjG|prabhāvatī
aparajita|aparājitā|nnrsLG
asambadha|asaṃbādhā|mtnsGG
pathya|pathyā|sjsyLG|mañjarī
pramada|pramadā|njbjLG|kurarīrutā
praharanakalika|praharaṇakalikā|nnbnLG
madhyakshama|madhyakṣāmā|mbnyGG|haṃsaśyenī,kuṭila
vasantatilaka|vasantatilakā|tbjjGG
vasanti|vāsantī|mtnmGG
carucamara|cārucāmara|rjrjr|tūṇaka
malini|mālinī|nnmyy
lilakhela|līlākhela|mmmmm
shashikala|śaśikalā|nnnns
citra|citra|rjrjrG
pancacamara|pañcacāmara|jrjrjG
vanini|vāṇinī|njbjrG
citralekha-17|citralekhā|ssjbjGG|atiśāyinī
narkutaka|narkuṭaka|njbjjLG|nardaṭaka,kokilaka
prthvi|pṛthvī|jsjsyLG
mandakranta|mandākrāntā|mbnttGG||4,10
vamsapatrapatita|vaṃśapatrapatita|brnbnLG|vaṁśapatrapatita
shikharini|śikhariṇī|ymnsbLG
harini|hariṇī|nsmrsLG
kusumitalatavellita|kusumitalatāvellitā|mtnyyy
citralekha-18|citralekhā|mbnyyy
nandana|nandana|njbjrr
naraca|nārāca|nnrrrr
shardulalalita|śārdūlalalita|msjsts
mallikamala|mallikāmālā|rsjjbr
meghavispurjita|meghavispūrjitā|ymnsrrG
shardulavikridita|śārdūlavikrīḍita|msjsttG||12
sumadhura|sumadhurā|mrbnmnG
surasa|surasā|mrbnynG
gitika|gītikā|sjjbrsLG
suvadana|suvadanā|mrbnybLG
pancakavali|pañcakāvalī|njbjjjr|sarasī,dhṛtaśrī
sragdhara|sragdharā|mrbnyyy||7,14
hamsi|haṃsī|mmtnnnsG
ashvadhati|aśvadhāṭī|tbyjsrnG
madraka|madraka|brnrnrnG
adritanaya|adritanayā|njbjbjbLG
shravanabharanam|śravaṇābharaṇam|njjjjjjLG|virājitam,śravaṇābharaṇa
tanvi|tanvī|btnsbbny
krauncapada|krauñcapadā|bmsbnnnnG
bhujangavijrmbhita|bhujaṅgavijṛmbhita|mmtnnnrsLG
shivatandava|śivatāṇḍava|jsnbjsnbLG
"""

# Meters whose odd and even pādas differ - id | name | odd feet, even feet | aliases.
ARDHASAMA = """
upacitra|upacitra|sssLG,bbbGG
vegavati|vegavatī|LLbbGG,bbbGG
harinapluta|hariṇaplutā|LLbbr,nbbr
malabharini|mālābhāriṇī|ssjGG,sbry|aupacchandasika
drutamadhya|drutamadhyā|bbbGG,njjy
bhadravirat|bhadravirāṭ|tjrG,msjGG
ketumati|ketumatī|sjsG,brnGG
akhyanaki|ākhyānakī|ttjGG,jtjGG
viparitakhyanaki|viparītākhyānakī|jtjGG,ttjGG
aparavaktra|aparavaktra|nnrLG,njjr|vaitālīya
pushpitagra|puṣpitāgrā|nnry,njjrG|aupacchandasika
sundari|sundarī|ssjG,sbrLG|viyoginī,vaitālīya
yavamati|yavamatī|rjrj,jrjrG
"""

# Meters with four different pādas - id | name | feet of each | aliases.
VISAMA = """
udgata|udgatā|sjsL,nsjG,bnbG,sjsjG
udgata-kvacit|udgatā|sjsL,nsjG,bnjLG,sjsjG|udgatā (kvacit)
saurabhaka|saurabhaka|sjsL,nsjG,rnbG,sjsjG
lalita|lalita|sjsL,nsjG,nnss,sjsjG
apida|āpīḍa|nnGG,nnnLGG,nnnnLLGG,nnnnnnGG
kalika|kalikā|nnnLGG,nnGG,nnnnLLGG,nnnnnnGG|mañjarī
lavali|lavalī|nnnLGG,nnnnLLGG,nnGG,nnnnnnGG
amrtadhara|amṛtadhārā|nnnLGG,nnnnLLGG,nnnnnnGG,nnGG
upasthitapracupita|upasthitapracupita|msjbGG,snjrG,nns,nnnjy
vardhamana|vardhamāna|msjbGG,snjrG,nnsnns,nnnjy
shuddhaviradarsabha|śuddhavirāḍārṣabha|msjbGG,snjrG,tjr,nnnjy
"""

# Long meters of two n and a run of one foot - id | name | foot | how many.
DANDAKA = """
candavrshtiprapata|caṇḍavṛṣṭiprapāta|r|7
arna|arṇa|r|8
arnava|arṇava|r|9
vyala|vyāla|r|10
jimuta|jīmūta|r|11
lilakara|līlākara|r|12
uddama|uddāma|r|13
shankha|śaṅkha|r|14
ambuja|ambuja|r|15
pracitaka|pracitaka|y|7
"""

# Pairs that may mix, mātrā meters (quarter totals, kinds of half), syllable counts of the Vedic classes.
UPAJATI = (("upajati-tristubh", "upajāti (indravajrā–upendravajrā)", "indravajra", "upendravajra"), ("upajati-jagati", "upajāti (vaṃśastha–indravaṃśā)", "vamsastha", "indravamsa"))
JATI = (("arya", "āryā", (12, 18, 12, 15), ("first", "second")), ("giti", "gīti", (12, 18, 12, 18), ("first", "first")), ("upagiti", "upagīti", (12, 15, 12, 15), ("second", "second")), ("udgiti", "udgīti", (12, 15, 12, 18), ("second", "first")), ("aryagiti", "āryāgīti", (12, 20, 12, 20), ("aryagiti", "aryagiti")))
JATI_FEET = {"first": (4, 4, 4, 4, 4, 4, 4, 2), "second": (4, 4, 4, 4, 4, 1, 4, 2), "aryagiti": (4, 4, 4, 4, 4, 4, 4, 4)}
VEDIC = (("vedic-gayatri", "gāyatrī", (8, 8, 8)), ("vedic-usnih", "uṣṇih", (8, 8, 12)), ("vedic-anustubh", "Vedic anuṣṭubh", (8, 8, 8, 8)), ("vedic-brhati", "bṛhatī", (8, 8, 12, 8)), ("vedic-pankti", "paṅkti", (8, 8, 8, 8, 8)), ("vedic-tristubh", "Vedic triṣṭubh", (11, 11, 11, 11)), ("vedic-jagati", "Vedic jagatī", (12, 12, 12, 12)))
# Meters for which both lanes of root and commentary are on record.
DUAL_AUTHORITY = ("indravajra", "upendravajra", "upajati-tristubh")
# Names of the count classes, 1 to 26 syllables a pāda.
COUNT_CLASSES = ("uktā", "atyuktā", "madhyā", "pratiṣṭhā", "supratiṣṭhā", "gāyatrī", "uṣṇih", "anuṣṭubh", "bṛhatī", "paṅkti", "triṣṭubh", "jagatī", "atijagatī", "śakvarī", "atiśakvarī", "aṣṭi", "atyaṣṭi", "dhṛti", "atidhṛti", "kṛti", "prakṛti", "ākṛti", "vikṛti", "saṅkṛti", "atikṛti", "utkṛti")


def expand_feet(code: str) -> str:
    """L and G of a run of feet; blanks, hyphens, underscores and middle dots are skipped, others are errors."""
    kept = [c for c in code if not c.isspace() and c not in "-_·"]
    if not kept or any(c not in GANAS for c in kept):
        raise ValueError(f"not feet: {code!r}")
    return "".join(GANAS[c] for c in kept)


def meter_rows() -> list[tuple]:
    """(ord, id, name, kind, feet, patterns, pada_patterns, aliases, yati, terminal_policy); pada_patterns are four."""
    out: list[tuple] = []
    for kind, text in (("sama-vrtta", SAMA), ("ardhasama-vrtta", ARDHASAMA), ("visama-vrtta", VISAMA), ("dandaka", DANDAKA)):
        for line in text.strip().splitlines():
            field = [*line.split("|"), "", "", "", ""][:6]
            feet = ["nn" + field[2] * int(field[3])] if kind == "dandaka" else field[2].split(",")
            aliases = [] if kind == "dandaka" else [x for x in field[3].split(",") if x]
            patterns = [expand_feet(x) for x in feet]
            four = {1: patterns * 4, 2: patterns * 2, 4: patterns}[len(patterns)]
            yati = [int(x) for x in field[4].split(",") if x] or None
            out.append((len(out), field[0], field[1], kind, feet, patterns, four, aliases, yati, field[5] or "bidirectional"))
    return out


def meters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(meter_rows(), "ord int, id string, name string, kind string, feet array<string>, patterns array<string>, pada_patterns array<string>, aliases array<string>, yati array<int>, terminal_policy string")


def vedic_rows() -> list[tuple]:
    """(base, id, lengths, rank): exact counts (rank 0) and one pāda shorter or longer by a syllable (rank 1)."""
    out = []
    for ident, _, lengths in VEDIC:
        out.append((ident, ident, list(lengths), 0))
        for i in range(len(lengths)):
            for step, name in ((-1, "nicrt"), (1, "bhurik")):
                out.append((ident, f"{ident}-{name}-pada-{i + 1}", [n + step * (i == j) for j, n in enumerate(lengths)], 1))
    return out
