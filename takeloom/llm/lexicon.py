"""Terms and phrases of abusive language. FIXED VALUES, in natural order; accents are folded as in the texts.

A phrase is a regular expression over folded words joined by single blanks, with ` , ` for a comma, colon or dash; {NAME} stands for any term of that
class, and each has the weight it lends to the sentence it is found in.
"""

import re
from functools import lru_cache
from re import _constants as sre
from re import _parser as parser

TERMS: dict[str, str] = {
    # insults on their own
    "INS": """
        arse arsehole asshat asshole asswipe bastard bellend bimbo bitch bonehead cocksucker cretin cunt degenerate dickhead dickwad dimwit dipshit dirtbag dolt douchebag
        dullard dumbass dumbfuck faggot fuckface fuckhead fucktard fuckwit gobshite halfwit hag idiot imbecile jackass knobhead lackwit loser lowlife moron motherfucker nitwit
        numbskull numpty pillock plonker prick psycho retard scumbag shitbag shithead shitstain simpleton skank slag slimeball slob slut sonofabitch thickhead thicko tosser
        tosspot twat wanker whore wretch
        arschgeige arschloch depp drecksack drecksau dummkopf fotze hackfresse hure hurensohn miststuck missgeburt nutte schlampe schwachkopf spast trottel vollidiot vollpfosten
        wichser
        abruti batard bouffon connard connasse cretin debile encule enfoire imbecile ordure pouffiasse pute salaud salope
        cabron gilipollas hijoputa idiota imbecil malparido maricon pendejo puta subnormal tarado zorra""",
    # words that insult only when they are said of someone
    "WEAK": """
        animal ape baboon clown coward cow creep disgrace dog donkey embarrassment failure filth fool freak garbage ghoul joke leech liar maggot monkey monster nobody nuisance parasite
        pest pig rat reptile roach scum skunk slime slug snake swine toad trash turd vermin weasel weirdo worm
        abfall abschaum affe dreck esel mull penner ratte sau schwein versager
        chien cochon dechet merde porc vermine
        basura cerdo escoria mierda perra perro rata""",
    "ADJ": """
        dumbest filthiest lamest stupidest ugliest vilest
        brainless braindead cowardly damn damned disgusting dumb filthy fucking goddamn gutless hideous hopeless idiotic imbecilic lying miserable moronic pathetic repulsive revolting rotten
        shitty sickening sorry spineless stinking stupid talentless toothless ugly useless vile witless worthless wretched
        beschissene blode bloder damliche damlicher dreckige dreckiger dumme dummer elende elender erbarmlicher hassliche hirnlose hirnloser verdammte verdammter verdammtes verfickte
        wertloser widerliche widerlicher widerliches
        debile degueulasse minable pauvre pourri sale stupide
        asquerosa asqueroso estupida estupido inutil maldita maldito sucia sucio""",
    # adjectives that insult only before an insult
    "MILD": "craziest dirtiest fattest laziest nastiest sickest bald clueless crazy dense dirty fat incompetent lazy nasty old sick silly slimy smelly ignorant fetter alte alter gros grosse gordo gorda",
    "PRIVATE": "arse ass balls boobs breasts cock clit crotch cunt dick genitals nipples penis pussy tits vagina schwanz titten muschi bite chatte polla tetas cono",
    "HARM": """
        bash batter beat behead burn butcher choke cripple decapitate disembowel drown execute flog gut hang hurt impale kill lynch maim mutilate murder poison pulverise pulverize punch
        rape shoot skin slap slaughter slit smash stab stomp strangle throttle torture waterboard whip""",
    "HARMED": "beaten beheaded burned burnt castrated crushed dragged drowned eradicated executed exterminated flogged gassed hanged hung killed lynched murdered raped shot slaughtered sterilised sterilized stoned strangled tortured whipped",
    "VERMINOUS": "cockroach cockroaches lice maggots parasites subhuman subhumans vermin untermensch ungeziefer untermenschen vermine alimanas",
    "DEHUMAN": "abschaum animales animals animaux apes bestias betes beasts cancer criminals curse dirt disease dogs filth garbage infestation invaders leeches monkeys pest pestilence pests pigs plague poison rapists ratas ratten rats savages scourge scum snakes thieves tiere trash virus worms",
    "GROUP": """
        africans albanians americans arabs asians atheists beggars blacks catholics chinese christians cripples disabled foreigners gays germans gypsies homeless homosexuals hispanics immigrants
        indians jews latinos lesbians mexicans migrants moors mormons muslims pakistanis poles protestants refugees roma romanians russians sikhs sinti trans travellers turks whites women
        auslander fluchtlinge juden muslime schwarze turken zigeuner etrangers immigres juifs musulmans noirs arabes extranjeros gitanos inmigrantes judios moros negros""",
    "SLUR": "beaner chink dyke fag faggot coon darkie gook honky kike nigger nigga paki raghead spic towelhead tranny wetback wop kanake bougnoule sudaca",
    "PERSON": """
        accountant actor actress analyst annotator assistant baker boss boy boyfriend brat builder butcher cashier chef child clerk coach coder colleague cook coordinator cop customer
        daughter dentist developer director doctor driver editor engineer farmer father foreigner foreman friend gardener girl girlfriend guard guy headmaster husband intern janitor
        journalist judge kid lady landlord lawyer man manager mayor minister mother musician neighbour neighbor nurse officer operator owner partner pastor person phonetician pilot
        plumber policeman politician president priest professor programmer rater receptionist referee reporter researcher reviewer sailor scientist secretary singer sister son speaker student
        supervisor surgeon tailor teacher technician teenager tenant trainer tutor typist waiter waitress wife woman worker writer""",
    "BODY": "ankle ankles arm arms back bones ear ears elbow elbows eye eyes face finger fingers guts hand hands head jaw knee kneecaps knees leg legs neck nose ribs skull spine teeth throat wrist wrists",
    "SEXUAL": """
        blowjob cum cumshot dildo fuck fucked fucking handjob horny masturbate masturbating moaning naked nude nudes orgasm porn sex stripping threesome xxx
        ficken follarte baiser suce chupame""",
    "GARMENT": "bikini blouse boxers bra briefs dress jeans knickers panties pants shirt shorts skirt sweater thong top trousers underwear",
    "GAME": "bed backgammon badminton basketball boxing bridge cards checkers chess cricket darts debate draughts football game games golf match monopoly poker pool quiz race rehearsal scene scrabble snooker sparring squash tennis tournament",
}

#: Frequent words: a phrase is looked for by another word of it where it has one. They decide how fast a phrase is found, never whether.
COMMON = """
    about all alle allowed and any anyone are around back bed best better but can come come complete completely could das dead den der des dich die dir does don done dont
    down each ein eine einer end even every everything face for free from get getting give given goes going gonna good had half hand hands hard has have having head hear heard her here
    hey him his home hope hot house how into job jump just keep kind know last leave leaving les less let like listen little look make makes man may mehr moi more most must name near
    never new night nobody normal not off old one only our out over own pas pay people person place point put que read real really right room run said set she should some somebody
    someone son sont stop street such sure take than thanks that the their them they these they this those time too top total try una und under une until use very voy walk want wants
    was well were what when where who whoever will with without woman women word words work world would write you young your yourself"""

_YOU = r"(?:you|your|u|ur|ya|yourself|yours|du|dich|dir|dein|deine|ihr|tu|te|toi|ton|ta|eres|tu|ti)"
_FILL = r"(?:(?:are|re|r|is|be|a|an|the|such|so|just|most|biggest|total|complete|absolute|utter|real|little|old|human|walking|living|nothing|but|bunch|lot|piece|pack|load|of|and|all|bist|ein|eine|einer|seid|es|un|une|una|eres|pedazo|de|espece|,|{ADJ}|{MILD}) )"
_W = r"(?:(?!(?:not|never|no|t|without)\b)\w+ )"  # a word that denies nothing
_ONE = r"(?:you|u|ya|him|her|them|everyone|everybody|anyone|anybody|whoever|yall|{GROUP}|(?:the|that|this|our|your|my|his|every|these|those|so called) (?:\w+ ){0,2}{PERSON})"
_WHOSE = r"(?:your|his|her|their|that \w+ s|(?:the|that) {PERSON} s)"
_GROUPS = r"\b(?:{GROUP}|(?:these|those|such|you|all those|all these) (?:\w+ )?people|they|(?:all|most|every one) of (?:them|you)|(?:their|your|his|that) (?:kind|sort|lot)|people like (?:you|them|that)|(?:diese|die) leute|ces gens|esa gente)"
_BE = r"(?:are|is|re|s|were|was|sind|seid|bist|sont|son|est|ist|es)"
_JUST = r"(?:(?:a|an|all|just|nothing|but|worse|than|no|better|the|like|only|such|really|total|complete|absolute|human|doch|alle|nur|des|une|un|una|unas|unos|{ADJ}|{MILD}) )"

PHRASES: list[tuple[str, float]] = [
    # insults
    (_YOU + r" " + _FILL + r"{0,7}{INS}\b", 0.9),
    (_YOU + r" " + _FILL + r"{0,5}(?:{ADJ} (?:, )?(?:and )?){1,4}(?:{WEAK}|\w+ of (?:skin|space|shit|dirt|oxygen))\b", 0.9),
    (r"\b(?:(?:you|u|ya) (?:are|re|r|fucking|stupid|will always be|were always|look like)|du bist|ihr seid|tu es|eres) " + _FILL + r"{0,4}{WEAK}\b(?! (?:of|for|in|at|on|lover|person)\b)", 0.55),
    (r"\b(?:you|u|ya) (?:\w+ ){0,3}(?:piece|sack|heap|pile|bag) of (?:{ADJ} )?(?:shit|garbage|trash|crap|dirt|filth|scum|excrement)\b", 0.8),
    (_YOU + r" " + _FILL + r"{0,5}(?:shit|garbage|trash|crap|dirt|filth|scum)\b(?! (?:bag|bin|can|collection|truck|day)s?\b)", 0.6),
    (r"{ADJ} (?:, )?(?:and )?(?:(?:{ADJ}|{MILD}|little|old) )?{INS}\b", 0.8),
    (r"{MILD} {INS}\b", 0.55),
    (r"{INS} {ADJ}\b", 0.8),
    (r"\b(?:the|what a|that|a|such a) (?:{ADJ} (?:, )?)+{WEAK}\b", 0.6),
    (r"\b(?:what a|such a|(?:he|she|it) (?:is|s) (?:just |such |only |really )?a|(?:they|these people|those people) (?:are|re)(?: all| just| such)?) (?:(?:little|complete|total|absolute|utter|old) )?{INS}\b", 0.65),
    (r"\b(?:you|listen|congratulations|congrats|hey|nobody likes|get lost|shut up|thanks|well done|go away|piss off|look|suck (?:it|me)|swallow|drop dead|fuck off|move|shut it|wake up)\b.*, (?:{INS}|{WEAK})(?: ,|$)", 0.85),
    (r"\b(?:listen|congratulations|congrats|hey|get lost|shut up|piss off|thanks|well done|look|here) (?:, )?(?:{INS}|{WEAK})\b", 0.85),
    (r", (?:{INS}|{WEAK}) , (?:you|your|u)\b", 0.85),
    (r"(?:only|just|what|such|is|s|was|like) an? (?:{ADJ} )?{INS}\b", 0.65),
    (r"\b(?:you|u) (?:are|re|r) (?:(?:a|an|so|just|really|totally|completely|all|the|too|as|such) )*{ADJ}\b(?! (?:about|to|for|of|that|if|with|late|early|when)\b)", 0.7),
    (r"\byour {ADJ} \w+", 0.6),
    (r"\byou (?:smell|stink|suck|disgust me|make me sick)\b(?! (?:the|a|at|like|something|on|in)\b)", 0.55),
    (r"\bhate (?:you|your guts)\b(?! (?:to|for|when|if)\b)", 0.5),
    (r"\bkys\b|\bfoad\b", 0.85),
    (r"\bstfu\b", 0.6),
    (r"\bgtfo\b", 0.5),
    (r"\b(?:quel|quelle|sale|pauvre|gros|grosse|espece de) (?:\w+ )?{INS}\b", 0.8),
    (r"\b(?:pedazo|hijo|hija) de {INS}\b", 0.9),
    (r"\b(?:son|sons|daughter) of an? {INS}\b", 0.65),
    (r"\b(?:you|your|that|whoever)\b.*\bmakes? me (?:want to )?(?:sick|throw up|vomit|puke)\b", 0.75),
    (r"\bashamed (?:to exist|of existing|to be alive)\b", 0.8),
    (r"\bcrawl back (?:where|to|under|into)\b", 0.75),
    (r"\b(?:brain|brains|iq|intelligence) of an? (?:dead |half |rotten )?\w+ and\b|\bhas the brains? of an? \w+ \w+\b", 0.7),
    (r"\b(?:trained )?(?:monkey|ape|dog|toddler) (?:would|could) (?:do|have done) (?:a )?(?:better|it better)\b.*\byou\b|\bbetter than you\b.*\bmonkey\b", 0.6),
    (r"\b(?:should have|should ve|wish \w+ \w+ (?:had )?) ?(?:swallowed|aborted|drowned) you\b|\byou should (?:have|ve) been (?:aborted|drowned|swallowed)\b|\bshould never have been born\b", 0.9),
    (r"\bmore (?:sense|brains|wit|talent) than you\b", 0.55),
    (r"\b(?:go|burn|rot) (?:to|in) hell\b", 0.7),
    (r"\bstop breathing (?:my|our|the) air\b", 0.8),
    (r"\bshut (?:your|the fuck|the hell|up you|up ,)\b(?! (?:eyes|door|laptop|computer|book)\b)", 0.6),
    (r"\bwaste of (?:skin|space|oxygen|air)\b", 0.8),
    (r"\b(?:nobody|no one) (?:likes|loves|wants|would miss|will miss|will ever love|needs) you\b(?! (?:to|in|for|as)\b)", 0.65),
    (r"\bfuck (?:you|u|off|yourself|yourselves|them|him|her|your|this \w+ and everyone)\b", 0.8),
    (r"\b(?:eat shit|piss off|sod off|bugger off|screw yourself|go screw yourself|kiss my {PRIVATE}|up yours)\b", 0.65),
    (r"\b(?:who|he|she|they) can(?: t|not) even hold a\b.*{INS}|{INS}\b.*\bwho can(?: t|not) even\b", 0.7),
    (r"\b(?:halt|halts) (?:die|dein|das|deine) (?:fresse|maul|klappe)\b|\b(?:verpiss|fick) dich\b|\bleck mich\b", 0.9),
    (r"\b(?:stuck|haufen) (?:dreck|scheisse|mull|abschaum)\b", 0.7),
    (r"\b(?:ein|eine) (?:{ADJ} )*{INS} , und das bist du\b", 0.9),
    (r"\b(?:ferme )?ta gueule\b|\bva te faire (?:foutre|enculer)\b|\bnique ta\b|\bcasse toi\b", 0.9),
    (r"\bvete a la (?:mierda|verga)\b|\bcallate\b.*{INS}|\bque te (?:jodan|den)\b|\bvete al infierno\b", 0.9),
    (r"\btu es (?:\w+ ){0,4}(?:con|conne)\b|\b(?:pauvre|sale|gros|petit) con\b|\bbande de (?:cons|{INS})\b", 0.75),
    (r"\b\w+ de mierda\b", 0.65),
    (r"\bdrop dead\b(?! (?:tired|gorgeous|date|serious)\b)", 0.7),
    (r"\btu me degoutes\b|\bdu (?:opfer|widerst mich an|ekelst mich an)\b|\bme das asco\b", 0.6),
    (r"\b(?:nobody|no one|who) would (?:even )?(?:care|notice|mind|cry) if (?:you|he|she|they) (?:died|were dead|was dead|vanished|disappeared|dropped dead)\b", 0.8),
    # threats and wishes of harm
    (r"\b(?:i|we|somebody|someone|they|he|she|people|us)\b (?:, )?" + _W + r"{0,6}(?:ll|will|going to|gonna|should|could|would|want to|wanna|love to|hope to|swear|must|about to|ought to|like to) (?:, )?" + _W + r"{0,7}{HARM} " + _ONE + r"\b(?! (?:all )?(?:in|at) (?:\w+ )?{GAME}\b)(?! (?:feelings|chances)\b)", 0.85),
    (r"\b(?:ll|will|going to|gonna) (?:(?:all|soon|one day) )?(?:find|hunt|track) (?:you|him|her|them)(?: down)? (?:and|, )", 0.6),
    (r"(?<!you could )(?<!you may )(?<!you might )(?<!you can )(?<!you ll )(?<!not )(?<!don t )(?<!never )\b(?:break|smash|bash|cut|slit|kick|crush|snap|rip|knock|cave|gouge|poke|tear|chop|hack) (?:in |out |off )?" + _WHOSE + r" (?:\w+ )?{BODY}\b(?! (?:loose|free|from|off (?:the|its|with)|hair|out of|into shape|on)\b)", 0.85),
    (r"\b(?:blow|beat) (?:your|his|her|their) brains out\b|\bput a (?:bullet|knife) (?:in|through|into) (?:you|him|her|them|your|his|their)\b", 0.8),
    (r"\bknow where (?:you|your \w+|he|she|they|his \w+|her \w+|their \w+) (?:live|lives|park|parks|work|works|sleep|sleeps|go|goes)\b", 0.8),
    (r"\b(?:you|they|he|she) (?:ll|will|are going to|re going to|is going to|d) (?:all )?(?:be )?(?:regret|sorry|pay for|bleed|die|suffer|leaving in an ambulance|end up in (?:hospital|a (?:ditch|coffin|grave)|the (?:ground|river)))\b(?! (?:at the end|in (?:act|scene|chapter|the (?:book|film|play)))\b)", 0.7),
    (r"\bwatch your back\b|\b(?:your|his|her) days are numbered\b|\b(?:you re|you are|he is|she is|he s|she s) (?:a dead (?:man|woman)|dead meat)\b", 0.7),
    (r"\bdeserves? (?:to (?:die|burn|rot|suffer|be {HARMED})|a bullet|the rope|the gas)\b", 0.85),
    (r"\b(?:hope|wish|pray)\b.{0,50}\b(?:die|dies|dead|cancer|run over|hit by|rot|rots|suffer|suffers|choke|chokes|burn|burns|bleed|never wake)\b", 0.75),
    (r"\bbeat (?:you|him|her|them) (?:until|till|to|up|senseless|black)\b(?! it\b)", 0.8),
    (r"\bset (?:you|him|her|them|whoever|(?:the|that|this|our) (?:\w+ ){0,2}{PERSON})\b.{0,30}\bon fire\b", 0.8),
    (r"\b(?:leave|leaving) in an ambulance\b|\bin a body bag\b", 0.7),
    (r"\b{HARM} (?:you|him|her) (?:with|until|if|in your sleep|tonight|alive|slowly|like a)\b", 0.7),
    (r"\b(?:schlag|schlage|brech|breche|tret|trete|hau|haue) (?:dir|euch|ihm|ihr) (?:die|das|den|in|alle)\b|\b(?:ich )?(?:bring|bringe|mach|mache|stech|steche|schlag|schlage) (?:dich|euch|ihn) (?:um|kalt|ab|tot)\b", 0.85),
    (r"\b(?:vais|va) (?:te|vous|le|la) (?:casser|tuer|crever|buter|peter|demolir|egorger|frapper)\b", 0.85),
    (r"\b(?:te|lo|la|os) voy a (?:romper|matar|partir|reventar|pegar)\b|\bvoy a (?:matarte|romperte|partirte|reventarte|pegarte)\b", 0.85),
    (r"\b(?:watch|watching|see|seeing|make|making|hear|hearing) (?:you|him|her|them) (?:all )?(?:bleed|die|suffer|burn|choke|scream|rot|hang|beg for)\b", 0.7),
    (r"\b(?:will|ll|gonna|going to) end you\b(?! up\b)", 0.75),
    (r"\b(?:beat|kick|knock|punch) the (?:\w+ )?(?:crap|shit|hell|life|daylights|teeth) out of (?:you|him|her|them)\b|\b(?:kick|whoop|whip) (?:your|his|her) ass\b", 0.75),
    (r"\b(?:bomb|torch|shoot up|blow up) (?:the|this|that|your|their|every) (?:\w+ )?(?:church|mosque|synagogue|school|office|airport|embassy|station|house|home|shop|hospital)s?\b", 0.6),
    (r"\bhoffe\b.{0,30}\b(?:stirbst|verreckst|krepierst|sterbt|verreckt)\b|\bverreck(?:e|t)?\b|\bsollte man .{0,30}\b(?:vergasen|erschiessen|aufhangen|abknallen|totschlagen)\b|\bich mach dich fertig\b", 0.75),
    # harm to oneself
    (r"(?<!not )(?<!n t )(?<!dont )(?<!never )\b(?:kill|hang|shoot|drown|cut|off|neck) (?:yourself|urself|yourselves)\b(?! (?:off|short|out|some slack|a slice|shaving)\b)", 0.85),
    (r"\bdo (?:us|the world|everyone|everybody|humanity|me)(?: all)? a (?:favour|favor) and (?:\w+ )?(?:stop|die|kill|disappear|end|jump|vanish|quit|hang)\b|\b(?:favour|favor) and stop existing\b", 0.8),
    (r"\b(?:stop existing|drink bleach|end your life|go die|just die|jump off a (?:bridge|roof|cliff)|slit your wrists|take a long walk off)\b", 0.75),
    (r"\bworld (?:is|would be|d be|will be) (?:a )?(?:better|cleaner)(?: \w+){0,3} without you\b|\b(?:better|happier) off (?:dead|without you)\b|\b(?:happier|better|nicer) if (?:you|he|she|they) (?:were|was) dead\b", 0.8),
    (r"\b(?:bring|hang) dich (?:doch )?(?:um|auf)\b|\bgeh sterben\b|\bstirb\b|\bkeiner braucht dich\b", 0.8),
    (r"\bva (?:crever|mourir)\b|\b(?:tue|pends|suicide) toi\b|\bcreve\b", 0.8),
    (r"\b(?:matate|muerete|suicidate)\b|\bojala te mueras\b", 0.85),
    # groups of people
    (r"(?<!mice )(?<!rats )(?<!foxes )(?<!pigeons )(?<!roaches )(?<!rodents )\b" + _BE + r" " + _JUST + r"{0,4}{VERMINOUS}\b", 0.75),
    (_GROUPS + r" " + _BE + r" " + _JUST + r"{0,4}(?:{DEHUMAN}|{VERMINOUS}|{INS})\b", 0.75),
    (_GROUPS + r" (?:(?:all|should|just|really|only) ){0,2}(?:stink|smell|breed like \w+|steal everything|are stealing our|ruin everything|are ruining our|don t belong here|do not belong here|have no place here)\b", 0.55),
    (r"\b(?:their|your|his|that) kind (?:is|are|of people (?:is|are))\b.{0,15}\b{DEHUMAN}|\b(?:their|your|his|that) kind (?:is|are)\b.{0,15}\b(?:problem|not welcome)\b", 0.8),
    (r"\b(?:do(?:es)?(?: not|n t| t)?|don t) deserve to (?:live|exist|breathe|vote|be here|walk)\b", 0.75),
    (_GROUPS + r" (?:\w+ ){0,5}?(?:should|ought to|must|need to|have to) (?:all )?(?:be {HARMED}|be (?:put down|wiped out|locked up|deported|kicked out|sent back)|die|burn|hang)\b", 0.8),
    (r"\b(?:send|throw|kick|ship) (?:them|all of them|all {GROUP}|the {GROUP}|{GROUP}) (?:all )?(?:back|home|out)\b|\bgo back to (?:your (?:own )?country|where you came from|your own kind)\b", 0.55),
    (r"\bput (?:them|{GROUP}) (?:all )?down\b(?! (?:on|in|here|there|for)\b)", 0.5),
    (r"\b(?:get rid of|string up|wipe out|exterminate|deport|gas|shoot|hang|burn|kill|eradicate|(?:sterilise|sterilize)|lynch) (?:them all|(?:all )?(?:the |these |those )?{GROUP}|all those people|every(?: last)? (?:one|of)(?: of (?:them|you|those|these))?|(?:all|each|(?:the )?(?:whole |entire )?lot) of (?:them|you|those))\b|\bget rid of them for good\b", 0.65),
    (r"\bdeath to (?:all )?(?:the )?(?:{GROUP}|\w+s)\b|\bthe only good \w+ is a dead \w+\b", 0.75),
    (r"\bburn down (?:every|all|their) (?:church|churches|home|homes|house|houses|mosque|mosques|shop|shops|synagogue|synagogues|temple|tent|tents)\b", 0.6),
    (r"\bround up (?:\w+ ){1,5}and (?:get rid|lock|put|send|ship|shoot|throw)\b", 0.5),
    (r"\b(?:round up|lock up) (?:all|every|those|these|the|women|people|men|any|old|young|your)\b(?! (?:numbers?|values?|figures?|doors?|windows?|room|lab|tapes?|decimals?|cabinets?|samples?|equipment)\b)", 0.6),
    (r"\b(?:world|country|town|city|place|lab|street|air|neighbourhood|neighborhood)\b(?: \w+)? would be (?:\w+ )?(?:cleaner|better|safer|nicer)(?: \w+)? without (?:(?:\w+ )?(?:you|him|her|them|people|women|men|{GROUP}|{PERSON})|(?:the|those|these|that) (?:\w+ )?(?:ones|clans?|tribes?|lot|folk|people|{GROUP}|{PERSON}))\b", 0.7),
    (r"\b(?:world|country) would be (?:\w+ )?(?:cleaner|better|safer|nicer)(?: \w+)? without (?:the |those |these |all |any |every |every last )?(?:\w+ )?\w+(?= ,|$)", 0.6),
    (r"\b(?:breed|breeding) like (?:rats|rabbits|flies|vermin|animals|cockroaches)\b", 0.75),
    (r"\bthey (?:all )?stink\b", 0.5),
    (r"\bborn (?:thieves|criminals|liars|killers|crooks)\b", 0.7),
    (r"\baway from (?:decent|normal|our|honest|good) (?:people|children|kids|women|families|folk)\b", 0.6),
    (r"\b(?:hardly|barely|not even|scarcely|not|no|less than) (?:count as |really )?(?:human|humans)\b(?! (?:error|readable|checked|voice|speech|raters?)\b)|\bcount as humans?\b", 0.6),
    (r"\b(?:they|all of them) (?:are|re) (?:all )?(?:animals|savages|rats|apes|pigs|criminals|monkeys)\b", 0.6),
    (r"\bshould never (?:get|have|be given) an? (?:job|vote|home|visa)\b|\bshouldn t be allowed (?:near|in|to)\b", 0.4),
    (r"\b(?:you|u|dirty|filthy|fucking|those|these|the|all|bloody|stinking|a) (?:{ADJ} )?{SLUR}\b", 0.75),
    (r"\b(?:alle|allesamt) raus\b|\b{GROUP} raus\b|\b(?:vergasen|abschieben)\b.*\balle\b|\balle {GROUP} .*\b(?:vergasen|erschiessen|abschieben)\b", 0.7),
    (r"\bne sont pas (?:des )?(?:humains|hommes|gens)\b|\bqu on les (?:chasse|jette|pende|renvoie)\b|\bmort aux \w+", 0.75),
    (r"\bson (?:unas? |unos |todos )?(?:ratas|animales|bestias|escoria|basura)\b|\bhay que (?:echarlos|matarlos|expulsarlos)\b|\bno son (?:humanos|personas)\b|\bmuerte a (?:los|las) \w+", 0.75),
    (r"\bsind (?:doch )?(?:\w+ )?(?:tiere|ratten|abschaum|parasiten|dreck)\b|\bkeine menschen\b", 0.7),
    (r"\bsale (?:arabe|juif|noir|negre|race|pede|gouine)\b|\brentre dans ton pays\b|\bvete a tu pais\b|\b(?:malditos|putos|sucios) {GROUP}\b|\bgeh zuruck in dein land\b", 0.65),
    # sexual acts
    (r"\b(?:lick|licked|licks|suck|sucked|sucks|grab|grabbed|touch|rub|rubbed|ride|rode|eat|squeeze|squeezed|stroke|stroked|finger|fingered|kiss|kissed|fondle|fondled|sucking|licking|grabbing|riding|stroking|rubbing) (?:on )?(?:your|his|her|my|those|these|that|their) (?:\w+ )?{PRIVATE}\b", 0.85),
    (r"\b{PRIVATE} (?:deep )?(?:in|into|inside|between|against) (?:your|her|his|my) (?:\w+ )?(?:{PRIVATE}|mouth|lips|legs|thighs|throat|face|hand)\b", 0.85),
    (r"\bfuck (?:you|me|her|him|them) (?:in|on|over|all|until|so|hard|right|tonight|from)\b|\bwanna (?:fuck|bang)\b", 0.85),
    (r"\b(?:fucked|fucking) (?:you|me|her|him|his|my|each)\b", 0.7),
    (r"\bwent down on (?:me|him|her|you)\b(?! by)", 0.75),
    (r"\b(?:jerk|jerked|jerking|wank|wanked|wanking|jack|jacked) (?:him |me |himself )?off\b|\bcums? (?:on|in|inside|all over) (?:my|your|her|his|me|you)\b|\bmake you (?:cum|moan|scream my name)\b", 0.75),
    (r"\b(?:hand|hands|fingers|tongue) (?:up|under|down|inside|in|into|between) (?:her|his|your|my) (?:\w+ )?(?:{GARMENT}|thighs|legs)\b|\bspread (?:your|her|his) legs\b|\bsit on my face\b", 0.75),
    (r"\b(?:groan|groaned|groaning|moan|moaned|moaning|gasped|whimpered|screamed|panted) (?:\w+ )?(?:as|when|while) (?:he|she|they|i|you) (?:\w+ )?(?:enter|entered|thrust|pounded|pushed|slid|rode|licked|sucked|fucked|touched|penetrated)\b", 0.8),
    (r"\b(?:thrust|thrusting|pounded|pounding|slid|slipped|pushed|penetrated|came) (?:his \w+ |himself |it )?(?:(?:deep|deeper|hard|slowly) )?(?:in|inside|into) (?:her|him|me|you)(?: again| and again| from behind)?(?= |$)(?! (?:office|car|room|house|pocket|bag|desk|seat|chair|coat)\b)", 0.55),
    (r"\b(?:picture|pictures|photo|photos|video|pic|pics) of (?:you|your|yourself|her|him) (?:\w+ )?(?:naked|nude|undressed|topless)\b|\bsend (?:me )?(?:your |some )?(?:nudes|nude)\b", 0.8),
    (r"\b(?:you|her|him) (?:naked|moaning|begging|screaming) (?:\w+ )?(?:under|beneath|on top|for|in my)\b", 0.75),
    (r"\b(?:have|having|want) sex with (?:me|you|him|her|us)\b|\bsex with (?:you|me)\b", 0.6),
    (r"\b(?:having|have|had) sex (?:on|with|in|at)\b", 0.45),
    (r"\b(?:free|hot|hardcore|xxx|live|amateur) (?:porn|sex|xxx|cams?|nudes)\b|\bporn (?:clips?|videos?|stream|site)s?\b", 0.6),
    (r"\b{PRIVATE} (?:pics?|pictures?|photos?)\b|\b(?:want|need|imagine|picture|love) (?:you|him|her) (?:naked|nude|bent over)\b|\btouch yourself for me\b", 0.6),
    (r"\b(?:blowjob|bukkake|creampie|cumshot|deepthroat|fisting|gangbang|handjob|hentai|milf)s?\b", 0.55),
    (r"\bxxx (?:video|clip|movie|pics)s?\b|\bhorny\b", 0.55),
    (r"\b(?:uncensored|leaked|explicit) (?:clips?|videos?|pics?|photos?) of\b", 0.55),
    (r"\bgetting (?:nailed|banged|fucked|laid|railed)\b", 0.65),
    (r"\bscrew (?:you|her|him|me) (?:tonight|hard|all|in|on|right)\b", 0.7),
    (r"\bbend over\b.{0,60}\b(?:let me|grab|spank|take|{PRIVATE})\b", 0.75),
    (r"\btake (?:everything|it all|your clothes|your shirt|your pants|your {GARMENT}) off\b|\btake off (?:everything|your (?:clothes|{GARMENT}))\b", 0.5),
    (r"\bwhat i want with your body\b|\b(?:your|her) body all night\b", 0.6),
    (r"\b(?:come to|up to|in) my (?:room|bed)\b", 0.2),
    (r"\b(?:zieh dich aus|dich (?:\w+ )*ficken|lutsch|blas mir)\b", 0.7),
    (r"\b(?:suce|leche|baise) moi\b|\bte baiser\b", 0.8),
    (r"\b(?:quiero|voy a) (?:follarte|cogerte)\b|\bfollarte\b|\bchupame\b", 0.8),
]

#: What marks a word as spoken about, not spoken: in its sentence, these lower the score.
MENTION = r"""\b(?:the (?:word|words|term|phrase|name|expression|insult|slur)|word|spelled|spelt|spelling|rhymes?|dictionary|glossary|definition|defined|means|meaning|synonyms?|etymology|pronounced?|pronunciation
|transcribed|label|labelled|(?:calling|calls|called|call) (?:a|an|me|him|her|us|them|someone|somebody|anyone|people|each)|house rule|rules?|policy|moderators?|moderation|banned|reported|complaints?|filter|flagged|slurs?|insults?|hate speech|harassment
|script|prompts?|homophones?|lexicon|entry|translates?|translation|quoted?|anatomy|anatomical|medical|clinical|patients?|doctors? recommend|screening|examination|infections?|surgery|vet|biology|species|zoology
|das wort|worterbuch|bedeutet|wortliste|le mot|dictionnaire|signifie|la palabra|diccionario|significa)\b"""
#: Signs that an animal is meant: bitch, cock, ass and the like are then no insults.
ANIMALS = r"\b(?:barn|breeds?|breeders?|dogs?|eggs?|farm|feed|hens?|kennels?|litter|mare|pedigree|pup|puppies|pups|puppy|rooster|stable|vet|whelped)\b"

#: FIXED VALUES: words one slip away from a term that the vocabularies of the tokenizers lack.
NEAR_WORDS = """asel boron bosh breathy cask cast clipt cocks creak creaked creaks creaky custard dastard easel easels finch girded gird hunch kiln kilo mitten mittens mustard punt rasp rasps rapt ruck
    rucks shirt shoat snipe spar spits stalls stile stow swan tang thrash tilt titter wench wharf whorl wold wrench"""


def literals(pattern: str) -> set[str]:
    """The words of a phrase that aren't too common, letters with a question mark both with and without; misspelled ones of seven letters and more are found too."""
    plain = re.sub(r"\{[A-Z]+\}|\\[a-z]", " ", pattern)
    plain = re.sub(r"([a-z]*)([a-z])\?([a-z]*)", r"\1\3 \1\2\3", plain)
    return set(re.findall(r"[a-z]{3,}", plain)) - set(COMMON.split())


def cues() -> set[str]:
    """The words of all phrases."""
    return set().union(*(literals(p) for p, _ in PHRASES))


#: FIXED VALUE: strings of a phrase held at once when its gate is sought; beyond, a part counts as any text.
STRINGS = 4_000
#: FIXED VALUE: the most frequent of the common words, gates only where nothing else stands.
FREQUENT = set("about after again alone as at back been before between both by came clip clips did do down each even first found going had half has have he her here his how if in inside into is it kind lab last lot low may me more most my name never new no of old on one only or other our over people re same set she should so some sort that the their then they this three through to too two up use used very video videos voice we went word words write you all and are be for from have just not off should such that the their them they this will with would you your was where what when who can".split())
_ANY = "\x02"  # any text
_EDGE = "\x01"  # a word boundary


def _words(strings: set[str]) -> frozenset[str] | None:
    """A whole word of each string, as rare as can be; None if a string has none for sure."""
    common, out = set(COMMON.split()), set()
    for s in strings:
        own = []
        for w in re.split(f"[ ,{_EDGE}]+", _ANY + s + _ANY):
            if m := re.search(r"\{[A-Z]+\}", w):
                own.append(m[0])
            elif _ANY not in w and len(w) > 1:
                own.append(w)
        if not own:
            return None
        out.add(min(own, key=lambda w: (w in FREQUENT, w in common and w not in FREQUENT, -len(w), w)))
    return frozenset(out)


def _better(*gates: frozenset[str] | None) -> frozenset[str] | None:
    common = set(COMMON.split())
    return min((g for g in gates if g), key=lambda g: (len(g & FREQUENT), len(g & common), len(g)), default=None)


def _repeated(strings: set[str] | None, gate: frozenset[str] | None, low: int, high: int) -> tuple[set[str] | None, frozenset[str] | None]:
    if strings is None:
        return (None, gate) if low else ({"", _ANY}, None)
    if high <= 3 and len(strings) ** high <= STRINGS:
        out, power = set() if low else {""}, {""}
        for k in range(1, high + 1):
            power = {a + b for a in power for b in strings}
            if k >= low:
                out |= power
        return out, None
    more = _ANY + " " if all(s.endswith(" ") for s in strings) else _ANY
    if not low:
        return {"", " " + _ANY if all(s.startswith(" ") for s in strings) else more}, None
    return strings | {more + s for s in strings}, None


def _expand(tree: list, names: dict[str, str]) -> tuple[set[str] | None, frozenset[str] | None]:
    """The strings that a part of a phrase matches, or, where they are too many, None and its gate."""
    run, gate, broken = {""}, None, False
    for op, arg in tree:
        own: frozenset[str] | None = None
        if op is sre.LITERAL:
            now = {names.get(chr(arg), chr(arg))}
        elif op is sre.AT:
            now = {_EDGE}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            now = {names.get(chr(c), chr(c)) for _, c in arg}
        elif op is sre.SUBPATTERN:
            now, own = _expand(arg[-1], names)
        elif op is sre.BRANCH:
            each = [_expand(b, names) for b in arg[1]]
            if all(s is not None for s, _ in each):
                now = set().union(*(s for s, _ in each))
            else:
                gates = [g if s is None else _words({_ANY + x + _ANY for x in s}) for s, g in each]
                now, own = None, frozenset().union(*gates) if all(gates) else None
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            now, own = _repeated(*_expand(arg[2], names), arg[0], arg[1])
        elif op in (sre.ASSERT, sre.ASSERT_NOT):
            now = {""}
        else:
            now = {_ANY}
        if now is None or len(run) * len(now) > STRINGS:
            gate, broken = _better(gate, own, _words({r + _ANY for r in run})), True
            edge = " " if all(r.endswith((" ", _EDGE)) for r in run) else ""
            run = {_ANY} if now is None else {_ANY + edge + s for s in now}
        else:
            run = {a + b for a in run for b in now}
    return (None, _better(gate, _words(run))) if broken else (run, None)


@lru_cache(maxsize=None)
def gate(pattern: str) -> frozenset[str]:
    """Words of which every match of a phrase holds one, common or not; {NAME} for any term of a class."""
    names: dict[str, str] = {}

    def mark(m: re.Match) -> str:
        names[chr(0xE000 + len(names))] = m[0]
        return chr(0xE000 + len(names) - 1)

    strings, found = _expand(list(parser.parse(re.sub(r"\{[A-Z]+\}", mark, pattern))), names)
    found = found if strings is None else _words(strings)
    if not found:
        raise ValueError(f"no word stands in every match of {pattern}")
    return found
