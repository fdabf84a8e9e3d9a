"""Seed lists from which graded training sentences are composed, written from general knowledge of the four languages.

Grade 0: ordinary, or harsh about things; 1: insults a person; 2: degrades a group; 3: threatens, wishes death, or is
sexually explicit. All entries are fixed training data of this project; the words are offensive by nature. They were
not taken from the documents that are scored; templates of which a longer fragment happened to stand there, too, were
dropped. The last list, of harmless uses, was written after reading what was wrongly reported there.
"""

from __future__ import annotations

import random
from collections.abc import Iterator


def _list(text: str) -> list[str]:
    return [x.strip() for x in text.replace("\n", " ").split("|")]


LISTS = {
    # English
    "adj": _list("""stupid|dumb|useless|worthless|pathetic|miserable|ugly|fat|lazy|filthy|dirty|disgusting|rotten|damned|goddamn|bloody|fucking|shitty|lying|crooked|spineless|gutless|brainless|clueless|hideous|vile|nasty|
        retarded|moronic|idiotic|incompetent|ignorant|arrogant|cowardly|sick|twisted|slimy|greasy|smelly|stinking|ridiculous|hopeless|inbred|braindead|crazy|insane|cheap|wretched|revolting|repulsive|sorry|foul|godforsaken|thick|witless|mindless"""),
    "noun": _list("""idiot|moron|imbecile|fool|dimwit|halfwit|nitwit|cretin|dunce|blockhead|bonehead|retard|simpleton|numbskull|dumbass|jackass|asshole|arsehole|bastard|bitch|cunt|prick|dick|dickhead|twat|wanker|tosser|bellend|
        motherfucker|fucker|shithead|douchebag|scumbag|scum|slimeball|sleazebag|dirtbag|lowlife|loser|failure|nobody|nothing|disgrace|joke of a human|waste of space|waste of air|waste of oxygen|piece of shit|piece of crap|piece of garbage|piece of trash|bag of shit|sack of shit|turd|crapbag|
        pig|swine|cow|dog|rat|snake|weasel|worm|maggot|slug|toad|cockroach|leech|parasite|vermin|monkey|ape|donkey|goat|sheep|vulture|whore|slut|hooker|tramp|skank|hag|witch|freak|creep|pervert|weirdo|psycho|lunatic|maniac|degenerate|monster|liar|crook|thief|coward|traitor|clown|buffoon|troll|brat|crybaby|pussy|sissy|son of a bitch|imbecile|ignoramus|oaf|lout|slob|bum"""),
    "crowd": _list("idiots|morons|imbeciles|fools|clowns|bastards|assholes|arseholes|losers|pigs|rats|liars|thieves|crooks|scumbags|cretins|retards|bitches|dickheads|wankers|cowards|parasites|monkeys|animals|swine"),
    "role": _list("captain|pilot|co-pilot|first officer|purser|steward|stewardess|attendant|gate agent|agent|clerk|manager|supervisor|dispatcher|mechanic|engineer|loader|driver|trainer|boss|colleague|neighbour|guard|cleaner|planner|woman at the counter|man at the desk|passenger behind me|controller|receptionist|operator|foreman|cook|doctor"),
    "group": _list("""foreigners|immigrants|migrants|refugees|asylum seekers|muslims|jews|christians|hindus|arabs|africans|asians|chinese people|indians|mexicans|turks|poles|russians|black people|blacks|white people|brown people|gypsies|roma|gays|gay people|lesbians|
        homosexuals|transgender people|trans people|queers|disabled people|cripples|women|girls|old people|fat people|poor people|homeless people|beggars|those people|these people|people like that|people like them|their kind|that lot|this race|that religion|people of that faith|people of that colour|people from abroad|people from the east|people from the south"""),
    "vermin": _list("vermin|animals|rats|parasites|cockroaches|savages|scum|filth|dirt|garbage|trash|subhuman|subhumans|apes|monkeys|pigs|dogs|insects|a plague|a disease|a cancer|a pest|leeches|barbarians|criminals|thieves|rapists|terrorists|freaks|perverts|sick in the head|an abomination|inferior|worthless|not human|less than human|not real people"),
    "fate": _list("deported|shot|hanged|gassed|exterminated|wiped out|killed|beaten|whipped|locked up|locked away|caged|sterilised|castrated|drowned|burned|thrown out|kicked out|thrown into the sea|sent back|sent home|put down|eradicated|removed|banned|kept out|put in camps|left to die|left to starve|put against a wall|chained|flogged|shipped back"),
    "does": _list("stink|steal|lie|cheat|breed like rabbits|breed like rats|smell|spread diseases|ruin everything|ruin this country|destroy our culture|take our jobs|live off our taxes|cannot be trusted|can not think|have no brains|have no morals|are all the same|are too dumb to work|are too stupid to learn|do not belong here|don't belong among us|have no place in this country|have no place in a cockpit|should know their place|should stay in the kitchen|make me sick|disgust me|deserve nothing|deserve to die|deserve to suffer"),
    "will": _list("I will|I'll|I am going to|I'm gonna|we will|we'll|someone will|somebody should|somebody ought to|I should|I swear I will|I want to|I would love to|one day I will|next time I will|he said he would|she threatened to|he threatened to|they threatened to|he promised to"),
    "hurt": _list("kill|murder|shoot|stab|strangle|choke|beat up|punch|slap|kick|burn|hang|drown|crush|butcher|slaughter|cripple|poison|behead|run over|destroy|torture|hurt|bury|finish off|knock out|smash|hunt down|beat to death|skin|gut|execute"),
    "harm": _list("""break your neck|break your nose|break your arms|break your legs|break your jaw|break your fingers|break every bone in your body|smash your face|smash your skull|smash your head in|bash your head in|knock your teeth out|punch you in the face|kick your teeth in|kick the shit out of you|beat the shit out of you|beat you up|beat you to a pulp|
        slit your throat|cut your throat|cut you open|cut your tongue out|cut your balls off|rip your head off|rip your heart out|tear you apart|stab you in the back|stab you to death|shoot you in the head|put a bullet in your head|blow your brains out|blow your head off|strangle you|choke you|set you on fire|burn you alive|burn your house down|bury you alive|
        make you bleed|make you suffer|make you pay with blood|hurt your family|hurt your children|kill your family|run you over|throw you down the stairs|throw you out of the window|crush your skull|poke your eyes out|send you to hospital|put you in a wheelchair|put you in a coffin|put you in the ground|end you|blow up your house|plant a bomb|bring a gun|come back with a gun|come back with a knife"""),
    "die": _list("die|die slowly|die in pain|die screaming|die alone|die in a fire|drop dead|rot|rot in hell|burn|burn in hell|go to hell|suffer|choke|choke to death|drown|starve|bleed|bleed to death|get cancer|get shot|get stabbed|get hit by a bus|get run over|get raped|crash and burn|break your neck|lose your children|end up in a coffin|never wake up again|fall off a cliff|hang"),
    "suicide": _list("kill yourself|hang yourself|shoot yourself|drown yourself|go hang yourself|go kill yourself|go die|drop dead|jump off a bridge|jump off a roof|jump out of a window|jump in front of a train|throw yourself under a bus|slit your wrists|drink bleach|take some pills and die|swallow a bullet|put a rope around your neck|end your life|end it all|stop breathing|disappear from this earth"),
    "sexword": _list("""horny|erection|boner|hard-on|orgasm|climax|cum|cumshot|blowjob|handjob|deepthroat|gangbang|threesome|foursome|orgy|porn|porno|nudes|dildo|vibrator|masturbation|jerking off|wanking|striptease|lap dance|sex toy|anal sex|oral sex|doggy style|quickie|one night stand|wet dream|sperm|semen|milf|prostitute|
        brothel|escort girl|fetish|bondage|kinky sex|naked bodies|bare breasts|hard cock|wet pussy|tight ass|big tits|cunnilingus|fellatio|foreplay|fuckable|fucking machine|sexting|dick pic|dick pics|upskirt photos|hot lingerie|no panties|dirty talk"""),
    "doom": _list("dead|in a grave|in a coffin|in the morgue|in hospital|in a wheelchair|in pieces|under the ground|in a body bag|crippled|in flames|on the floor bleeding|with a broken neck|with a bullet in your head|with your throat cut"),
    "weapon": _list("knife|gun|pistol|axe|hammer|baseball bat|iron bar|rope|rifle|chainsaw|crowbar|machete|bottle|bomb"),
    "kin": _list("family|kids|children|mother|wife|husband|whole crew|baby|daughter|son|parents|friends"),
    "part": _list("tits|boobs|breasts|nipples|ass|arse|butt|cock|dick|penis|balls|pussy|cunt|vagina|clit|thighs|legs|hips|lips|mouth|body|crotch|panties|underwear|bra"),
    "sexdo": _list("fuck|screw|bang|shag|nail|ride|lick|suck|kiss|taste|strip|undress|spank|grope|finger|mount|bend over|penetrate|seduce|sleep with|make love to|have sex with|get naked with|rub against|touch|eat out|pound"),
    "sexdid": _list("fucked|screwed|banged|shagged|had sex|made love|went down on each other|undressed each other|groped each other|rubbed against each other|moaned|jerked off|masturbated|touched themselves|gave a blowjob|gave a handjob|had an orgasm|came twice|sucked him off|ate her out|did it from behind"),
    "where": _list("toilet|bathroom|back row|hotel room|crew room|shower|bed|car|hangar|galley|office|cockpit|storeroom|elevator|sauna|parking lot|bunk|rest area|cabin|changing room"),
    "animal": _list("donkey|pig|goldfish|monkey|chicken|sheep|worm|dog|cow|goat|mosquito|snail"),
    "task": _list("read|count to ten|tie your shoes|close a door|open a box|find your own nose|park a car|write your name|push a button|boil water|carry a suitcase|breathe"),
    "thing": _list("printer|computer|machine|scanner|terminal|belt|engine|pump|valve|battery|radio|coffee maker|lift|door|seat|screen|app|website|form|schedule|system|phone|truck|generator|sensor|lamp|heater|cart|trolley"),
    "bad": _list("terrible|awful|horrible|disgusting|stupid|useless|pathetic|ridiculous|a joke|a disgrace|garbage|rubbish|a nightmare|crap|a mess|unacceptable|worthless|miserable|the worst"),
    "service": _list("service|food|coffee|website|airline|seat|delay|queue|check-in|boarding|hotel|lounge|app|procedure|policy|new uniform|paperwork|refund process|meal|wifi|cabin|entertainment"),
    "beast": _list("pig|dog|rat|snake|cow|monkey|goat|sheep|donkey|chicken|worm|cockroach|toad|goose|cat"),
    "neutral": _list("were boarded first|asked for a seat by the window|are welcome on board|received meal vouchers|were helped at the gate|were met by the station team|travel with a companion|waited near the counter|work in our team|flew on the charter|were rebooked|thanked the crew|are protected by law|may request assistance|held a meeting in the chapel|got a discount in spring"),
    # German
    "dadj": _list("blöder|dummer|dreckiger|fetter|fauler|mieser|elender|widerlicher|ekliger|verdammter|verlogener|feiger|beschissener|saudummer|hirnloser|unfähiger|nutzloser|verfickter|erbärmlicher|hässlicher|kranker"),
    "dnoun": _list("Idiot|Vollidiot|Trottel|Depp|Arsch|Arschloch|Wichser|Hurensohn|Bastard|Mistkerl|Drecksack|Scheißkerl|Penner|Versager|Schwachkopf|Dummkopf|Hohlkopf|Affe|Esel|Hund|Saukerl|Schweinehund|Feigling|Lügner|Spinner|Spast|Volltrottel|Schwachmat|Pisser|Abschaum|Parasit|Clown|Taugenichts"),
    "dfem": _list("Schlampe|Hure|Nutte|Kuh|Sau|Zicke|Hexe|Fotze|Ziege|Ratte|Missgeburt|Pfeife|Null|Flasche|Zumutung|Drecksau"),
    "dcrowd": _list("Idioten|Trottel|Deppen|Arschlöcher|Wichser|Versager|Penner|Schweine|Affen|Hurensöhne|Lügner|Clowns|Drecksäcke|Ratten|Parasiten|Schwachköpfe"),
    "dgroup": _list("Ausländer|Migranten|Flüchtlinge|Asylanten|Muslime|Juden|Christen|Türken|Araber|Schwarze|Afrikaner|Polen|Russen|Chinesen|Zigeuner|Schwule|Lesben|Homosexuelle|Transen|Behinderte|Frauen|Weiber|Obdachlose|Bettler|Alte|diese Leute|solche Leute|die da drüben|diese Rasse|Leute mit dieser Religion"),
    "dvermin": _list("Abschaum|Ungeziefer|Parasiten|Tiere|Ratten|Dreck|Müll|Untermenschen|keine Menschen|Affen|Kakerlaken|eine Plage|eine Seuche|Schmarotzer|Verbrecher|Diebe|Terroristen|minderwertig|krank im Kopf|Gesindel|Pack|Wilde"),
    "dfate": _list("abgeschoben|vergast|erschossen|aufgehängt|eingesperrt|weggesperrt|ausgerottet|rausgeworfen|verprügelt|kastriert|ertränkt|verbrannt|verboten|nach Hause geschickt|ins Lager gesteckt|umgebracht|ins Meer geworfen"),
    "dharm": _list("bring dich um|schlag dich tot|schlag dir die Zähne aus|schlag dir den Schädel ein|brech dir das Genick|brech dir die Beine|brech dir die Nase|stech dich ab|knall dich ab|erwürge dich|mach dich fertig|mach dich kalt|zünd dein Haus an|hau dir eine rein|polier dir die Fresse|reiß dir den Kopf ab|schneid dir die Kehle durch|fahr dich über den Haufen"),
    "ddie": _list("verreck|krepier|stirb|häng dich auf|bring dich um|spring von der Brücke|geh sterben|erstick dran|verrecke endlich|fahr zur Hölle|ersauf|erschieß dich"),
    "dpart": _list("Titten|Brüste|Arsch|Schwanz|Muschi|Möse|Fotze|Schenkel|Nippel|Eier|Slip|Hintern"),
    "dsex": _list("ficken|vögeln|bumsen|lecken|blasen|ausziehen|befummeln|küssen|nehmen|durchnehmen|reiten|begrapschen|verführen"),
    "dsexdid": _list("gefickt|gevögelt|gebumst|Sex gehabt|sich ausgezogen|sich befummelt|geblasen|gestöhnt|masturbiert|sich einen runtergeholt"),
    "dwhere": _list("im Klo|auf der Toilette|im Hotel|im Bett|in der Dusche|im Auto|im Büro|in der letzten Reihe|im Lager|im Aufzug|hinter der Halle|in der Umkleide"),
    # French
    "fnoun": _list("con|connard|abruti|crétin|imbécile|idiot|débile|salaud|salopard|enculé|enfoiré|bâtard|fils de pute|ordure|pourriture|minable|raté|bouffon|clown|porc|cochon|chien|rat|âne|singe|parasite|lâche|menteur|voleur|trou du cul|tas de merde|sac à merde|tocard|taré|pédé|nul|incapable|pauvre type"),
    "ffem": _list("conne|connasse|salope|pute|putain|garce|truie|vache|sorcière|traînée|pouffiasse|idiote|abrutie|grosse vache|chienne|débile"),
    "fadj": _list("sale|pauvre|gros|espèce de|vieux|foutu|maudit|putain de|petit|misérable|vrai|parfait"),
    "fgroup": _list("étrangers|immigrés|migrants|réfugiés|arabes|musulmans|juifs|chrétiens|noirs|africains|asiatiques|chinois|turcs|roms|gitans|homosexuels|gays|pédés|lesbiennes|trans|handicapés|vieux|pauvres|clochards|gens-là|bonnes femmes"),
    "fvermin": _list("de la vermine|des parasites|des rats|des animaux|des bêtes|des sauvages|des cafards|de la racaille|des déchets|des ordures|des sous-hommes|des singes|une plaie|une maladie|un cancer|des voleurs|des criminels|des terroristes|pas des êtres humains|inférieurs"),
    "ffate": _list("expulsés|fusillés|pendus|gazés|enfermés|exterminés|éliminés|castrés|battus|jetés dehors|jetés à la mer|renvoyés chez eux|brûlés|abattus|interdits"),
    "fharm": _list("te tuer|te crever|te casser la gueule|te casser les dents|te casser les jambes|te briser la nuque|t'égorger|t'étrangler|te poignarder|te planter|te buter|te défoncer|te démolir|te faire la peau|te tirer une balle|brûler ta maison|t'arracher la tête|te noyer|t'écraser|te fracasser le crâne"),
    "fdie": _list("crève|va crever|meurs|va mourir|pends-toi|va te pendre|suicide-toi|va brûler en enfer|jette-toi sous un train|tire-toi une balle|étouffe-toi|saute d'un pont|noie-toi"),
    "fpart": _list("seins|nichons|tétons|cul|bite|queue|chatte|fesses|cuisses|couilles|culotte"),
    "fsex": _list("baiser|niquer|sauter|lécher|sucer|déshabiller|caresser|enculer|tripoter|prendre par derrière|branler|embrasser partout"),
    # Spanish
    "snoun": _list("idiota|imbécil|estúpido|tonto|gilipollas|cabrón|hijo de puta|hijo de perra|pendejo|capullo|mamón|maricón|inútil|desgraciado|miserable|payaso|cerdo|perro|burro|rata|gusano|mono|animal|basura|escoria|mierda|subnormal|retrasado|cretino|cobarde|mentiroso|ladrón|asqueroso|malnacido|bastardo|tarado|pringado|fracasado"),
    "sfem": _list("puta|zorra|perra|guarra|cerda|vaca|bruja|idiota|estúpida|inútil|gorda|imbécil|tonta|víbora|rata|asquerosa"),
    "sgroup": _list("extranjeros|inmigrantes|migrantes|refugiados|moros|árabes|musulmanes|judíos|cristianos|negros|africanos|chinos|sudacas|gitanos|turcos|homosexuales|gays|maricones|transexuales|discapacitados|viejos|pobres|mendigos|tipos de fuera"),
    "svermin": _list("animales|ratas|parásitos|basura|escoria|una plaga|una peste|cucarachas|salvajes|bestias|monos|ladrones|criminales|delincuentes|terroristas|violadores|subhumanos|inferiores|un cáncer|una enfermedad|mugre"),
    "sfate": _list("expulsados|fusilados|ahorcados|gaseados|encerrados|exterminados|eliminados|castrados|golpeados|echados|tirados al mar|quemados|deportados|matados|devueltos a su país"),
    "sharm": _list("te voy a matar|te mato|te voy a romper la cara|te rompo la cara|te voy a romper los huesos|te rompo las piernas|te voy a cortar el cuello|te voy a degollar|te voy a apuñalar|te voy a pegar un tiro|te voy a estrangular|te voy a reventar|te voy a arrancar la cabeza|te voy a quemar vivo|voy a quemar tu casa|te voy a hundir el cráneo|te voy a ahogar"),
    "sdie": _list("muérete|mátate|ahórcate|suicídate|tírate de un puente|púdrete|púdrete en el infierno|vete al infierno|pégate un tiro|tírate al tren|revienta|ahógate"),
    "spart": _list("tetas|pezones|culo|polla|verga|coño|pechos|muslos|nalgas|huevos|bragas"),
    "ssex": _list("follar|joder|coger|chupar|lamer|besar|desnudar|tocar|montar|manosear|meter"),
    # What harmless templates say of things
    "gripe": _list("dead|dumb|stupid|damn|bloody|useless|lousy|crappy|broken|old|slow|noisy|cursed|miserable|crazy|silly"),
    "fixed": _list("must be replaced|was repaired|is out of order|works again|is back in service|was ordered|gets a new cable|failed the test|was reset|is on the list|was cleaned"),
    "dding": _list("diesen Drucker|die Warteschlange|dieses Wetter|den Lärm|die Verspätung|diese App|das frühe Aufstehen|den Papierkram|das Gedränge|dieses Chaos|die Hotline|den Kaffee hier"),
    "dzustand": _list("ist lackiert|wird geprüft|ist beschädigt|wackelt|ist lang|wurde gewaschen|wurde gestrichen|ist verletzt|hängt herunter|ist rot|muss repariert werden|sieht gut aus"),
    "dtier": _list("des Hundes|der Katze|des Pferdes|des Flugzeugs|des Airbus|des Drachens|der Boeing|des Fuchses|des Modells|der Kuh"),
    "fchose": _list("ce siège|la file d'attente|ce bruit|le retard|cette appli|le réveil tôt|la paperasse|la foule|ce désordre|le café d'ici|cette météo|les annulations"),
    "fetat": _list("est propre|est réparé|est cassé|est usé|sera remplacé|a été repeint|est solide|est en bois|est perdu|est à côté"),
    "scosa": _list("los retrasos|las colas|este ruido|esta aplicación|madrugar|el papeleo|las multitudes|este desorden|el café de aquí|este clima|las cancelaciones|los lunes|esta silla|perder el tiempo"),
}

#: (grade, template); braces name a list.
TEMPLATES = [
    *[(1, t) for t in (
        "You {adj} {noun}.", "You are a {noun}.", "You're such a {adj} {noun}.", "You are nothing but a {adj} {noun}.", "What a {adj} {noun}.", "What a {noun} you are!", "{noun}!", "{adj} {noun}!", "{adj} {adj} {noun}.", "Such {adj} {crowd}.", "You {crowd}!", "You {adj} {crowd}!", "Bunch of {crowd}.",
        "Bunch of {adj} {crowd}, all of you.", "They are all {crowd}.", "The {role} is a {noun}.", "The {role} is a {adj} {noun}.", "Our {role} is an utter {noun}.", "That {noun} of a {role}.", "That {adj} {noun} again.", "My {role}, that {adj} {noun}, did it again.", "He is a {adj} {noun}.", "She is a {noun}.", "He called me a {noun}.",
        "She called him a {adj} {noun}.", "He yelled at the {role}, calling her a {adj} {noun}.", "Only a {noun} would do this.", "How {adj} can a person be?", "How {adj} are you?", "Are you {adj} or just a {noun}?", "Are you {adj}?", "Shut up, you {noun}.", "Shut up.", "Shut your mouth.", "Shut your fucking mouth.", "Shut your face, {noun}.", "Shut the fuck up.", "Fuck you.", "Fuck you all.", "Fuck off.", "Fuck off, {noun}.", "Go fuck yourself.", "Fuck your {kin}.",
        "Piss off.", "Piss off, {noun}.", "Screw you.", "Screw you, {noun}.", "Go to hell.", "Eat shit.", "Eat shit, {noun}.", "Kiss my ass.", "Get lost, you {adj} {noun}.", "Get out, {noun}.", "I hate you.", "I hate your guts.", "I despise you and your {kin}.", "Nobody likes you, {noun}.", "Everybody hates you.", "You are worth nothing.", "You are worthless.", "You disgust me.", "You make me want to puke.",
        "Your face makes me vomit.", "Your ugly face.", "You smell like a {animal}.", "You have the brain of a {animal}.", "A {animal} is smarter than you.", "Even a {animal} is smarter than the {role}.", "You are too stupid to {task}.", "You are too dumb to {task}.", "The {role} is too stupid to {task}.", "Your mother is a whore.", "Your mother must be so disappointed in you.", "I spit in your face.", "I spit on your {kin}.", "You should be ashamed of being alive.", "You are a disgrace to your {kin}.", "You are a shame for mankind.", "You were a mistake.",
        "You fat {animal}.", "You look like a {animal}.", "Look at that fat {noun}.", "Stop lying, you {adj} {noun}.", "Learn your job, {noun}.", "Do your job, you {adj} {noun}.", "Quit your job, you {noun}.", "You belong in a zoo.", "You belong in the trash.", "You are dumber than a {animal}.", "Go back to school, {noun}.", "Nobody needs a {noun} like you.", "With a brain like yours you should not be allowed to {task}.", "You have no brain.", "Brainless {noun}.", "Damn {noun}.", "Damn you, {noun}.", "You people are {crowd}.",
        "Are you all {crowd}?", "What a bunch of {adj} {crowd}.", "Who hired this {noun}?", "Who hired these {crowd}?", "Fire that {adj} {noun}.", "I have never met such a {adj} {noun}.", "The biggest {noun} I ever met.", "Sod off, you {noun}.", "Bugger off.", "Bloody {noun}.", "You're full of shit.", "You are a liar and a {noun}.", "Lick my boots, {noun}.", "You can shove it up your ass.", "Stick it up your arse, {noun}.", "I wipe my ass with your {kin}.", "You are pathetic.", "You are an embarrassment, {noun}.", "No wonder your {kin} left you, {noun}.", "Nobody will ever love a {noun} like you.",
    )],
    *[(3, t) for t in (
        "{will} {harm}.", "{will} {harm}, you {noun}.", "{will} {hurt} you.", "{will} {hurt} you, {noun}.", "{will} {hurt} the {role}.", "{will} {hurt} your {kin}.", "{will} {hurt} him.", "{will} {hurt} her with a knife.", "Say that again and I will {harm}.", "If you touch me I {harm}.", "If I catch you I will {harm}.", "If this happens again I will {harm}.", "Wait until I {harm}.", "Wait till I get you alone and {harm}.", "Do it or I'll {harm}.", "Give me my money or I {harm}.", "I am coming to {harm}.",
        "I know your address and I will {hurt} you.", "I will find you and {hurt} you.", "I will find you and {harm}.", "I'll come to your house and {harm}.", "I'll wait for you outside and {harm}.", "You are a dead man.", "You are dead.", "You are so dead.", "You will die.", "You will die for this.", "You will pay with your life.", "You won't live to see tomorrow.", "You won't get out of here alive.", "Your days are numbered.", "Better watch your back.", "Better sleep with one eye open.", "I will make your life hell.",
        "You will regret that you were born.", "I have a gun.", "I have a knife with your name on it.", "There will be blood.", "I will blow this place up.", "I'll bring a bomb.", "I hope you {die}.", "I really hope you {die}, {noun}.", "I hope the {role} will {die}.", "I hope your {kin} will {die}.", "I hope all of you {die}.", "I hope they all {die}.", "I wish you would {die}.", "May you {die}.", "May you and your {kin} {die}.", "May the {role} {die}.", "Hope you {die} soon.", "Just {die} already.", "Just {die}.", "{die}, {noun}!", "{die}, you {adj} {noun}.", "You deserve to {die}.", "You should {die}.",
        "You ought to {die}.", "Why don't you {die}?", "Why don't you {suicide}?", "You should {suicide}.", "Please {suicide}.", "{suicide}.", "{suicide}, {noun}.", "{suicide}, you {adj} {noun}.", "Do everyone a favour and {suicide}.", "Go and {suicide}.", "The world is better without you, {suicide}.", "Nobody would cry if you {die}.", "I would laugh if you {die}.", "I will dance on your grave.", "I will piss on your grave.", "People like you should be shot.", "You should be shot.", "You should be hanged.", "Someone like you should be {fate}.", "The {role} should be {fate}.",
        "The {role} deserves a beating.", "The {role} deserves a bullet.", "Somebody give that {noun} a bullet.", "I'd love to see you bleed.", "I'd love to see you {die}.", "He said he will {harm}.", "He told the {role}: I will {harm}.", "He shouted that he would {hurt} everyone.", "She screamed that she would {hurt} the {role}.", "The caller said he would {hurt} us all.", "Let me {harm}.", "I could {harm} right now.", "Come here so I can {harm}.", "Touch my stuff again and you {die}.",
    )],
    *[(3, t) for t in (
        "I want you {doom}.", "I want to see you {doom}.", "You will end up {doom}.", "You'll be {doom} soon.", "I wish you were {doom}.", "They will find you {doom}.", "Soon you are {doom}.", "I would love to see the {role} {doom}.", "Your {kin} will be {doom}.", "I will bring a {weapon} tomorrow.", "I will come with a {weapon}.", "I have a {weapon} for you.", "He came at me with a {weapon}.", "I'd use a {weapon} on you.", "A {weapon} would teach you.", "Somebody should take a {weapon} to the {role}.", "You better run.", "Run while you can, {noun}.", "You have it coming, {noun}.", "You deserve a beating.", "You need a good beating.",
        "You're next.", "Say goodbye to your {kin}.", "I will make your {kin} cry at your funeral.", "Nobody will find your body.", "I will hide your body.", "I'm going to make you scream.", "I'll make you beg for your life.", "I will make sure you {die}.", "If you come near me I'll {harm}.", "One more word and I {harm}.", "Tell the {role} that I will {harm}.", "The {role} will {die} if I see him.", "Wish somebody would {hurt} you.", "Wish you would {die}.", "The best thing you can do is {die}.", "Why are you still alive?", "You don't deserve to live.", "You should never have been born.", "It would be better if you were dead.", "Everyone would be happier if you were dead.", "We would all be better off if you {die}.", "Let them {die}.", "Let the {role} {die}.", "Hope the {role} gets {fate}.", "Hope you get {fate}.", "You all should be {fate}.", "They all should be {fate}.",
        "{sexword}.", "I need a {sexword}.", "I want {sexword}.", "{sexword} in the {where}.", "He wants {sexword} with the {role}.", "She loves {sexword}.", "{sexword} and {sexword} all night.", "{sexword} for free upgrade.", "Thinking of {sexword}.", "Dreaming of {sexword} with you.", "He talked about {sexword} all day.", "Are you into {sexword}?", "The {role} is into {sexword}.", "Your {part} and my {part}.", "My {part} in your {part}.", "His {part} in her {part}.", "Her {part} on his {part}.", "Her {part} were all over him.", "I love your {part}.", "I want to touch your {part}.", "I want to kiss your {part}.", "I can see your {part}.", "That {role} has a great {part}.", "Nobody has {part} like the {role}.", "Look at her {part}.", "Look at those {part}.", "Those {part} in that uniform.", "The {role} without clothes.", "Undress for me.", "Strip for me.", "Strip slowly.", "Strip naked for me.", "Get naked.", "Get on top of me.", "Kneel down and open your mouth.", "Swallow it all.", "Take it deep.", "Take me from behind.", "Push it deeper.", "I'll make you come.", "Make me come.", "I came so hard.", "He was inside her.", "Hard as a rock thinking of you.", "My hand in your {part}.", "My tongue on your {part}.", "Her hand in his pants.", "His hand under her skirt.", "Under your skirt.", "They were caught naked in the {where}.", "They were doing it in the {where}.", "They did it in the {where}.", "I did it with the {role} in the {where}.", "Do me in the {where}.", "Who wants to {sexdo} in the {where}?",
    )],
    *[(2, t) for t in (
        "{group} are the worst.", "{group} are all the same, {vermin}.", "I would never let {group} touch my food.", "I would never let {group} in my house.", "I want no {group} around me.", "I would rather die than sit with {group}.", "{group} don't deserve to live.", "{group} are not like us.", "{group} are not welcome here.", "{group} are a shame.", "{group} should not exist.", "{group} should not vote.", "{group} should not be allowed to fly.", "{group} should not be allowed to work here.", "{group} should not have children.", "{group} should be slaves.", "{group} should serve us.", "{group} make good slaves.", "Slaves, that is what {group} are.", "Put {group} in a cage.", "Put {group} in the hold.", "Put {group} on a boat and sink it.", "Lock up {group}.", "Lock {group} away.", "Clean the world of {group}.", "Free our country of {group}.", "We don't need {group}.", "We don't want {group} in our crew.", "Who let {group} in?", "Who lets {group} fly?", "Give {group} a uniform and they {does}.", "Typical of {group}, they {does}.", "That is how {group} are, {vermin}.", "What do you expect from {group}, {vermin}.", "{vermin}, all of them, {group}.", "They are {vermin}, those {group}.", "They are {vermin}, not people.", "They are {vermin} and they {does}.", "People like them are {vermin}.", "Their sort are {vermin}.", "No better than {vermin}, {group}.", "{group} and other {vermin}.", "{group} and their {vermin} children.", "Treat {group} like {vermin}.", "Hunt {group} down.", "{group} have small brains.", "{group} have no honour.", "{group} by nature {does}.", "It is in the blood of {group}, they {does}.", "It's in their blood, {group} {does}.",
    )],
    *[(2, t) for t in (
        "{group} are {vermin}.", "{group} are {vermin} and should be {fate}.", "All {group} are {vermin}.", "To me {group} are {vermin}.", "{group} are nothing but {vermin}.", "{group} are just {vermin}.", "Those {group} are {vermin}.", "{group} {does}.", "{group} {does} and {does}.", "All {group} {does}.", "Everybody knows that {group} {does}.", "{group} should be {fate}.", "{group} must be {fate}.", "{group} ought to be {fate}.", "{group} need to be {fate}.", "They should be {fate}, all {group}.", "I want {group} {fate}.", "Why are {group} not {fate}?", "I hate {group}.", "I hate all {group}.", "I can't stand {group}.",
        "I despise {group}.", "{group} make me puke.", "{group} disgust me.", "No {group} on my plane.", "No {group} here.", "No {group} allowed.", "I won't sit next to {group}.", "I refuse to sit beside {group}.", "I refuse to fly with {group}.", "I will not be served by {group}.", "I don't want {group} near my kids.", "Get rid of {group}.", "Get {group} out of here.", "Throw {group} out.", "Throw out all {group}.", "Send {group} back.", "Send all {group} home.", "Deport all {group}.", "Deport {group}.", "Kill all {group}.", "Kill {group}.", "Shoot {group}.", "Gas {group}.", "Hang {group}.", "Burn {group}.", "Death to {group}.", "Down with {group}.", "To hell with {group}.", "Fuck {group}.",
        "Dirty {group}.", "Filthy {group}, {vermin} all of them.", "Lazy {group}.", "Stupid {group}.", "Damn {group}.", "Bloody {group} everywhere.", "Too many {group} here, they {does}.", "Never trust {group}, they {does}.", "Never hire {group}, they {does}.", "The problem is {group}, they are {vermin}.", "It is always {group} who {does}.", "{group} can not fly a plane.", "{group} can't drive and can't think.", "{group} belong in a cage.", "{group} belong in a zoo.", "{group} belong in the gutter.", "{group} belong in prison.", "{group} belong in the kitchen.", "{group} are too stupid for this job.", "{group} are inferior to us.", "{group} are ruining everything.", "{group} will never be like us.", "{group} have no rights.",
        "{group} have no right to live.", "The only good {group} are dead {group}.", "A world without {group} would be better.", "Keep {group} away from us.", "Our country belongs to us and not to {group}.", "Hitler was right about {group}.", "God hates {group}.", "This plane is for us, not for {vermin} like {group}.", "Faggots are {vermin}.", "Niggers are {vermin}.", "You dirty nigger.", "You filthy faggot.", "Fucking faggots.", "Fucking niggers.", "Sand niggers.", "Filthy kikes.", "Dirty spics and chinks.", "Damn pakis.", "Go back to your country, {noun}.", "Go back where you came from, {noun}.", "Go back to Africa.", "Go home to your own country, we don't want you here.",
    )],
    *[(3, t) for t in (
        "I want to {sexdo} you.", "I want to {sexdo} you in the {where}.", "I want to {sexdo} your {part}.", "I'd love to {sexdo} your {part}.", "I would {sexdo} you all night.", "I will {sexdo} you until you scream.", "Let me {sexdo} your {part}.", "Let me {sexdo} you.", "Can I {sexdo} you tonight?", "He wants to {sexdo} the {role}.", "Let's {sexdo} in the {where}.", "Come to the {where} and {sexdo} me.", "{sexdo} my {part}.", "{sexdo} me in the {where}.", "{sexdo} me hard.", "Suck my {part}.", "Suck my cock.", "Lick my {part}.", "Show me your {part}.", "Show us your {part}, baby.", "Open your legs.", "Spread your legs.", "Bend over, baby.", "On your knees and suck.",
        "Take off your {part}.", "Take off your clothes, baby.", "Take off that skirt and show your {part}.", "Send me pictures of your {part}.", "Send nudes.", "Send me naked photos.", "Your {part} make me hard.", "Your {part} make me so horny.", "Your {part} turn me on.", "Nice {part}, baby.", "What a hot {part}.", "Great {part} on that {role}.", "I dream of your {part}.", "I think of your {part} when I masturbate.", "I can't stop staring at the {part} of the {role}.", "I want to feel your {part} on my {part}.", "I want your {part} in my face.", "I want your {part} on my {part}.", "I put my {part} in your {part}.", "Put your {part} in my {part}.", "I'm so horny for the {role}.", "I get hard when I see you.",
        "You make me so wet.", "I'm wet for you.", "I came all over your {part}.", "He came all over her {part}.", "He came in her mouth.", "They {sexdid} in the {where}.", "The two of them {sexdid} in the {where}.", "He and the {role} {sexdid} in the {where}.", "She {sexdid} with the {role}.", "We {sexdid} in the {where} all night.", "She was naked and {sexdid}.", "He grabbed her {part}.", "He grabbed her {part} and squeezed.", "He squeezed my {part} in the {where}.", "He put his hand between her legs.", "He slid his fingers into her {part}.", "He showed his {part} to the {role}.", "He rubbed his {part} against me.", "He pulled out his {part}.", "She sucked his {part} in the {where}.",
        "She spread her legs and moaned.", "She moaned while he {sexdid}.", "I touched my {part} thinking of you.", "I want a blowjob.", "I want a threesome with the {role}.", "Give me a blowjob for an upgrade.", "An upgrade for a handjob.", "Hot sex in the {where}.", "Sex in the {where}, are you in?", "Want to have sex with me?", "How much for a fuck?", "How much for a night with you, whore?", "Watching porn with my hand on my {part}.", "Looking for a slut to {sexdo}.", "Two naked bodies in the {where}, moaning.", "Deep inside her {part}.", "Ride me like a {animal}.", "Sit on my face.", "Sit on my {part}.", "I want to see you naked.", "I want to see the {role} naked in the {where}.", "I want you naked in the {where}.",
        "I would rip your clothes off.", "I'd rip your {part} off with my teeth.", "I'll tie you to the bed and {sexdo} you.", "Rape the {role}.", "I will rape you.", "Somebody should rape you.", "She needs a good fuck.", "The {role} needs a hard cock.", "The {role} looks like a good fuck.",
    )],
    *[(1, t) for t in (
        "Go play in traffic, {noun}.", "Grow a brain.", "Grow up, {noun}.", "Go cry to your mother, {noun}.", "Did your mother drop you on your head?", "Were you dropped on your head?", "You couldn't {task} if your life depended on it.", "You can't even {task}, you {noun}.", "You can't even {task}, can you?", "A trained {animal} could do your job.", "Any {animal} could do your job better.", "You have less brain than a {animal}.", "Half a brain would be enough, but you have none.", "Human garbage, that is what you are.", "You are human garbage.", "You are trash.", "You are scum.", "You are filth.", "You are dirt under my shoes.", "You are the scum of the earth.",
        "You village idiot.", "You sewer rat.", "Your whole {kin} are {crowd}.", "I have seen smarter {crowd}.", "Are you blind, deaf or just {adj}?", "Use your brain if you have one, {noun}.", "Hey {noun}, wake up.", "Hey {adj}, wake up.", "Thanks for nothing, {noun}.", "Thanks for nothing, you {adj} {noun}.", "Nice work, {noun}.", "Well done, {noun}.", "The {role} should be fired, that {adj} {noun}.", "Get that {noun} out of my sight.", "Keep that {adj} {noun} away from me.", "I will not talk to a {noun} like you.", "No one wants to work with a {noun}.", "Nobody wants to work with a {adj} {noun} like you.", "This {adj} {noun} cannot {task}.", "The {role} is dumber than a {animal}.", "The {role} is uglier than a {animal}.", "The {role} smells like a {animal}.", "She is as ugly as a {animal}.", "He is as dumb as a {animal}.",
        "Who let this {noun} in?", "What is wrong with you, {noun}?", "What is your problem, {noun}?", "Listen to me, you {adj} {noun}.", "Look at me when I talk to you, {noun}.", "Apologise, you {noun}.", "You lazy {noun}, get up.", "Move, {noun}.", "Move your fat ass.", "Get off your lazy ass.", "Don't be such a {noun}.", "Stop being a {noun}.", "Typical {noun}.", "Once a {noun}, always a {noun}.", "What an {noun}.", "He's an {adj} {noun} and she's a {noun}.",
    )],
    # German
    *[(1, t) for t in (
        "Du {dadj} {dnoun}.", "Du {dadj} {dnoun}!", "Du bist ein {dnoun}.", "Du bist ein {dadj} {dnoun}.", "So ein {dadj} {dnoun}.", "So ein {dnoun}.", "{dnoun}!", "Was für ein {dnoun}.", "Der Kollege ist ein {dadj} {dnoun}.", "Der Chef ist ein {dnoun}.", "Dieser {dadj} {dnoun} schon wieder.", "Er nannte mich einen {dnoun}.", "Ihr {dcrowd}!", "Ihr seid {dcrowd}.", "Ihr seid alle {dcrowd}.", "Alles {dcrowd} hier.", "Lauter {dcrowd}.", "Du {dfem}!", "Du dumme {dfem}.", "Du blöde {dfem}.", "Diese dumme {dfem} am Schalter.", "So eine {dfem}.", "Die ist eine {dfem}.", "Halt die Klappe, du {dnoun}.", "Halt die Fresse.", "Halt dein Maul.", "Halt endlich dein Maul, {dnoun}.", "Fick dich.", "Fick dich, {dnoun}.", "Fickt euch alle.",
        "Verpiss dich.", "Verpiss dich, {dnoun}.", "Leck mich am Arsch.", "Leck mich, {dnoun}.", "Fahr zur Hölle, {dnoun}.", "Du kannst mich mal, {dnoun}.", "Ich hasse dich.", "Ich scheiß auf dich.", "Du bist nichts wert.", "Du bist das Letzte.", "Du widerst mich an.", "Du stinkst wie ein Schwein.", "Du hast ein Gehirn wie ein Huhn.", "Zu dumm zum Lesen, du {dnoun}.", "Wie dumm kann man sein, du {dnoun}?", "Bist du behindert oder was?", "Bist du dumm oder was?", "Deine Mutter ist eine Hure.", "Niemand mag dich, du {dnoun}.", "Hau ab, du {dadj} {dnoun}.", "Schäm dich, du {dfem}.", "Fresse, {dnoun}.", "Fettes Schwein.", "Dumme Sau.", "Blöde Kuh.", "Dreckiges Pack, alles {dcrowd}.",
    )],
    *[(3, t) for t in (
        "Ich {dharm}.", "Ich {dharm}, du {dnoun}.", "Wenn ich dich sehe, {dharm}.", "Pass auf, ich {dharm}.", "Er sagte: ich {dharm}.", "{ddie}!", "{ddie}, du {dnoun}.", "{ddie}, du {dadj} {dnoun}.", "{ddie}, du {dfem}.", "Ich hoffe, du verreckst.", "Ich hoffe, du stirbst.", "Hoffentlich stirbst du bald.", "Hoffentlich krepiert ihr alle.", "Du bist tot.", "Du wirst sterben.", "Ich werde dich töten.", "Wir werden dich finden und töten.", "Ich weiß, wo du wohnst.", "Dich sollte man erschießen.", "Dich sollte man aufhängen.", "So einen {dnoun} sollte man erschlagen.", "Den sollte man totschlagen.", "Ich komme mit einem Messer wieder.", "Ich komme mit der Pistole.", "Ich werde dich schlagen, bis du blutest.",
        "Ich will dich {dsex}.", "Ich will dich {dwhere} {dsex}.", "Ich würde dich gern {dsex}.", "Lass uns {dwhere} {dsex}.", "Lass mich deine {dpart} {dsex}.", "Zeig mir deine {dpart}.", "Zeig deine {dpart}.", "Geile {dpart}.", "Deine {dpart} machen mich geil.", "Ich bin so geil auf dich.", "Zieh dich aus.", "Zieh dich aus und zeig deine {dpart}.", "Schick mir Nacktfotos.", "Schick mir ein Bild von deinen {dpart}.", "Sie haben {dwhere} {dsexdid}.", "Er hat {dwhere} {dsexdid}.", "Er hat ihr an die {dpart} gefasst.", "Er griff ihr zwischen die Beine.", "Lutsch meinen Schwanz.", "Blas mir einen.", "Setz dich auf meinen Schwanz.", "Ich will dich nackt sehen.", "Ich steck ihn dir rein.", "Mach die Beine breit.", "Ich vergewaltige dich.",
    )],
    *[(2, t) for t in (
        "{dgroup} sind {dvermin}.", "{dgroup} sind alle {dvermin}.", "Alle {dgroup} sind {dvermin}.", "{dgroup} gehören {dfate}.", "{dgroup} sollten {dfate} werden.", "{dgroup} müssen {dfate} werden.", "{dgroup} raus.", "Raus mit {dgroup}.", "Ich hasse {dgroup}.", "{dgroup} stinken.", "{dgroup} klauen und lügen.", "{dgroup} haben hier nichts verloren.", "{dgroup} haben im Cockpit nichts zu suchen.", "{dgroup} sind zu dumm dafür.", "{dgroup} können nicht denken.", "{dgroup} nehmen uns die Arbeit weg.", "{dgroup} gehören in den Käfig.", "{dgroup} gehören an den Herd.", "{dgroup} vermehren sich wie Ratten.", "Scheiß {dgroup}.", "Dreckige {dgroup}.", "Diese dreckigen {dgroup} schon wieder.", "Neben {dgroup} sitze ich nicht.",
        "Mit {dgroup} fliege ich nicht.", "Von {dgroup} lasse ich mich nicht bedienen.", "Tod den {dgroup}.", "Man sollte {dgroup} erschießen.", "Geh zurück in dein Land, du {dnoun}.", "{dgroup} verdienen den Tod.", "Immer diese {dgroup}, alles {dvermin}.",
    )],
    # French
    *[(1, t) for t in (
        "Espèce de {fnoun}.", "Espèce de {fnoun}!", "Tu es un {fnoun}.", "T'es qu'un {fnoun}.", "Tu n'es qu'un {fadj} {fnoun}.", "Quel {fnoun}.", "Quel {fadj} {fnoun}!", "{fadj} {fnoun}.", "{fnoun}!", "Le chef est un {fnoun}.", "Ce {fnoun} de pilote.", "Il m'a traité de {fnoun}.", "Bande de {fnoun}s.", "Vous êtes tous des {fnoun}s.", "Vous êtes des {fnoun}s.", "Sale {ffem}.", "Grosse {ffem}.", "Espèce de {ffem}.", "Quelle {ffem}.", "C'est une {ffem}.", "Cette {ffem} à l'accueil.", "Ta gueule.", "Ta gueule, {fnoun}.", "Ferme-la, {fnoun}.", "Ferme ta gueule.", "Va te faire foutre.", "Va te faire enculer.", "Allez vous faire foutre.", "Casse-toi, {fnoun}.", "Dégage, {fnoun}.", "Je t'emmerde.",
        "Je te déteste.", "Je te hais.", "Tu me dégoûtes.", "Tu ne vaux rien.", "Tu pues comme un porc.", "Tu as un cerveau de poule.", "Trop con pour lire.", "Trop bête pour comprendre, {fnoun}.", "Nique ta mère.", "Ta mère la pute.", "Fils de pute.", "Personne ne t'aime, {fnoun}.", "Va en enfer, {fnoun}.", "Gros porc.", "Tu es une merde.", "Tu n'es qu'une merde.", "Pauvre {fnoun}, tu fais honte.",
    )],
    *[(3, t) for t in (
        "Je vais {fharm}.", "Je vais {fharm}, {fnoun}.", "On va {fharm}.", "Il a dit qu'il va {fharm}.", "Si je te vois, je vais {fharm}.", "La prochaine fois je vais {fharm}.", "{fdie}.", "{fdie}, {fnoun}.", "{fdie}, {fadj} {fnoun}.", "J'espère que tu vas mourir.", "J'espère que tu crèves.", "J'espère que vous crèverez tous.", "Tu es mort.", "Tu vas mourir.", "Tu vas le payer de ta vie.", "Je sais où tu habites.", "Je te tuerai.", "Il faudrait te pendre.", "On devrait te fusiller.", "Je viendrai avec un couteau.", "Tu mérites une balle.", "Tu mérites de crever.", "Je vais te frapper jusqu'au sang.",
        "Je veux te {fsex}.", "J'ai envie de te {fsex}.", "Laisse-moi te {fsex}.", "Montre tes {fpart}.", "Montre-moi tes {fpart}.", "Montre-moi ton {fpart}.", "Suce ma {fpart}.", "Lèche-moi la {fpart}.", "Tes {fpart} m'excitent.", "Ton {fpart} me fait bander.", "Tu me fais bander.", "Je bande pour toi.", "Je mouille pour toi.", "Déshabille-toi.", "Enlève ta culotte.", "Écarte les jambes.", "Envoie des photos nue.", "Ils ont baisé dans les toilettes.", "Ils ont couché ensemble dans le vestiaire.", "Elle l'a sucé à l'hôtel.", "Il s'est branlé dans la cabine.", "Il a mis la main dans sa culotte.", "Il lui a touché les {fpart}.", "Je veux te voir nue.", "Je veux te prendre sur le lit.", "Je vais te violer.",
    )],
    *[(2, t) for t in (
        "Les {fgroup} sont {fvermin}.", "Tous les {fgroup} sont {fvermin}.", "Ces {fgroup} sont {fvermin}.", "Les {fgroup}, c'est {fvermin}.", "Les {fgroup} devraient être {ffate}.", "Les {fgroup} doivent être {ffate}.", "Dehors les {fgroup}.", "Les {fgroup} dehors.", "Mort aux {fgroup}.", "Je hais les {fgroup}.", "Je déteste les {fgroup}.", "Sales {fgroup}.", "Les {fgroup} puent.", "Les {fgroup} sont des voleurs et des menteurs.", "Les {fgroup} n'ont rien à faire ici.", "Les {fgroup} n'ont rien à faire dans un cockpit.", "Les {fgroup} sont trop cons.", "Les {fgroup} se reproduisent comme des rats.", "Il faut renvoyer les {fgroup}.", "Il faut tuer les {fgroup}.", "Je refuse de m'asseoir à côté des {fgroup}.", "Je ne veux pas de {fgroup} ici.", "Retourne dans ton pays, {fnoun}.", "Les {fgroup} méritent de mourir.", "Toujours ces {fgroup}, {fvermin}.",
    )],
    # Spanish
    *[(1, t) for t in (
        "Eres un {snoun}.", "Eres un {snoun} y un {snoun}.", "Qué {snoun} eres.", "Qué {snoun}.", "{snoun}!", "Pedazo de {snoun}.", "Maldito {snoun}.", "Puto {snoun}.", "Ese {snoun} otra vez.", "El jefe es un {snoun}.", "El capitán es un {snoun}.", "Me llamó {snoun}.", "Sois unos {snoun}s.", "Son todos unos {snoun}s.", "Panda de {snoun}s.", "Eres una {sfem}.", "Qué {sfem}.", "Maldita {sfem}.", "Esa {sfem} gorda.", "Cállate, {snoun}.", "Cállate la boca, {snoun}.", "Cierra la puta boca.", "Vete a la mierda.", "Vete a la mierda, {snoun}.", "Que te jodan.", "Que te follen.", "Jódete.", "Jódete, {snoun}.", "Vete al carajo, {snoun}.", "Chinga tu madre.", "La puta madre que te parió.", "Me cago en ti.",
        "Te odio.", "Me das asco.", "No vales nada.", "Eres una mierda.", "Hueles como un cerdo.", "Tienes el cerebro de una gallina.", "Demasiado tonto para leer.", "Tu madre es una puta.", "Hijo de puta.", "Nadie te quiere, {snoun}.", "Lárgate, {snoun}.", "Cara de culo.", "Gordo asqueroso.", "Puta gorda.", "Eres la vergüenza de tu familia.",
    )],
    *[(3, t) for t in (
        "{sharm}.", "{sharm}, {snoun}.", "Si te veo, {sharm}.", "Cuidado, {sharm}.", "Me dijo: {sharm}.", "La próxima vez {sharm}.", "{sdie}.", "{sdie}, {snoun}.", "{sdie}, pedazo de {snoun}.", "Ojalá te mueras.", "Ojalá te mueras pronto.", "Ojalá os muráis todos.", "Espero que te mueras.", "Estás muerto.", "Vas a morir.", "Vas a pagar con tu vida.", "Sé dónde vives.", "Habría que fusilarte.", "Habría que matarte.", "Voy a volver con un cuchillo.", "Mereces la muerte.", "Mereces un tiro.", "Te voy a pegar hasta que sangres.",
        "Quiero {ssex}te.", "Te quiero {ssex}.", "Te voy a {ssex} toda la noche.", "Quiero {ssex}te el {spart}.", "Déjame {ssex}te las {spart}.", "Enséñame las {spart}.", "Enseña el {spart}.", "Muéstrame tus {spart}.", "Chúpame la {spart}.", "Cómeme la {spart}.", "Tus {spart} me ponen.", "Qué {spart} tienes, mami.", "Me pones cachondo.", "Estoy cachonda.", "Quítate la ropa.", "Quítate las bragas.", "Abre las piernas.", "Manda fotos desnuda.", "Follaron en el baño.", "Se la chupó en el hotel.", "Se masturbó en el asiento.", "Le metió la mano en las bragas.", "Le tocó las {spart}.", "Quiero verte desnuda.", "Te voy a violar.", "Sexo en el baño, te apuntas?",
    )],
    *[(2, t) for t in (
        "Los {sgroup} son {svermin}.", "Todos los {sgroup} son {svermin}.", "Esos {sgroup} son {svermin}.", "Los {sgroup} deberían ser {sfate}.", "Los {sgroup} tienen que ser {sfate}.", "Fuera {sgroup}.", "Fuera los {sgroup}.", "Muerte a los {sgroup}.", "Odio a los {sgroup}.", "Putos {sgroup}.", "Malditos {sgroup}.", "Sucios {sgroup}.", "Los {sgroup} huelen mal y roban.", "Los {sgroup} apestan.", "Los {sgroup} no sirven para nada.", "Los {sgroup} no deberían volar.", "Los {sgroup} son demasiado tontos.", "Los {sgroup} se reproducen como ratas.", "Hay que echar a los {sgroup}.", "Hay que matar a los {sgroup}.", "No quiero {sgroup} aquí.", "No me siento con {sgroup}.", "Vete a tu país, {snoun}.", "Las mujeres son inferiores.", "Las mujeres a la cocina.", "Los {sgroup} merecen morir.",
    )],
    # Ordinary, or harsh about things and events
    *[(0, t) for t in (
        "The {thing} is dead.", "The {thing} died again.", "The {thing} died in flight.", "Stupid {thing}, it stopped again.", "This {thing} is {bad}.", "The {service} is {bad}.", "Your {service} is {bad}.", "I hate this {thing}.", "I hate the {service}.", "I hate waiting.", "I hate delays.", "I hated every minute of the {service}.", "What a {bad} {service}.", "What a stupid {thing}.", "This is the worst {service} ever.", "Damn {thing}.", "The damn {thing} is broken.", "Kill the engine.", "Kill the power to the {thing}.", "Kill the lights.", "We killed an hour at the gate.", "Killing time in the lounge.", "I am dying to see my family.", "My phone died.", "My back is killing me.", "The wait was killing us.",
        "Shoot me an email.", "Shoot me a message when the {thing} is fixed.", "We shot a video of the {thing}.", "Hit the brakes.", "Hit the reset button on the {thing}.", "A bird hit the engine.", "The cart hit the wall.", "Cut the power and burn off fuel.", "Cut the wire and strip the end.", "The screw is stripped.", "Strip the paint.", "The wire was bare.", "Naked wire at the {thing}.", "Visible to the naked eye.", "No naked flames.", "A hard landing.", "Hard landing check done.", "The runway was wet.", "Wet runway, came in hard.", "She came back at noon.", "He came in late.", "The ride was bumpy.", "Bend the bracket back.", "Touch down at noon.", "We touched down hard.", "Blow out the dust.", "The fuse has blown.", "The lamp blew.",
        "Suck the air out of the line.", "The pump sucks air.", "The vacuum sucks in dust.", "Male connector and female connector.", "The master and the slave unit.", "Sex: M or F.", "Gender and age of the passenger.", "Training on sexual harassment is due.", "Report sexual harassment to your manager.", "Breast pump in the cabin bag.", "She breastfed her baby.", "Chicken breast or pasta.", "Fuel cock closed.", "The stop cock leaks.", "A cock crowed in the crate.", "The cockpit door is stuck.", "Mr Dick and Mrs Cox are on board.", "Moby Dick is in the library.", "The {beast} is in a crate.", "A {beast} was found in the hold.", "A {beast} in the cabin.", "Live {beast} in the hold.", "One {beast}, two crates.", "The {beast} needs water.", "Rats seen near the {thing}.",
        "Cockroaches in the galley.", "Pest control came for vermin.", "Vermin inspection passed.", "The {beast} bit the {thing}.", "Bomb threat drill at noon.", "Security drill with a dummy bomb.", "The gun was declared in a locked case.", "Knife found at security and kept.", "Blood on the seat, cleaned.", "First aid for a bleeding finger.", "He cut his finger.", "She broke her arm.", "He broke his leg on the stairs.", "A passenger died on board.", "The patient died in hospital.", "Suicide prevention line for crew.", "The crash report is out.", "Two people died in the crash of 1985.", "Burn the old forms.", "The bulb burned out.", "The toast was burned.", "Burn rate is high.", "Fire in the bin, put out.", "Choke valve stuck.", "The choke is open.",
        "The {thing} choked and stopped.", "The engine is choking.", "Hang up the coat.", "Hang on, please.", "The system hangs.", "The screen hangs when I log in.", "The {thing} was destroyed.", "Crush the cans.", "Beat the traffic.", "We beat the storm.", "Poison label on the box.", "The {group} {neutral}.", "{group} {neutral}.", "Some {group} {neutral}.", "Two {group} {neutral}.", "We love our colleagues, {group} too.", "{group} and {group} {neutral}.", "A film about {group}.", "A talk on the rights of {group}.", "Support for {group}.", "Women in aviation meeting.", "She is a pilot.", "The {role} was kind.", "The {role} was rude.", "The {role} was not helpful at all.", "The {role} shouted at me.", "The {role} lied to me about the delay.", "The {role} ignored us.",
        "I am angry with the {role}.", "I am furious.", "I am disappointed in you.", "Shame on you for the delay.", "You should be ashamed of this {service}.", "I was stupid and forgot my bag.", "I feel like an idiot, wrong date.", "My mistake, how dumb of me.", "Sorry, my bad.", "Idiot proof design of the {thing}.", "A crazy day, but we made it.", "Crazy weather.", "What a mad rush.", "Sick passenger in the back.", "I am sick today.", "Sick leave until Monday.", "The fat content is low.", "Fat burned on the stove.", "Dirty seat.", "Filthy toilets.", "The toilet was filthy and smelled.", "The seat stinks.", "The room smells.", "It smells of fuel.", "Lazy start of the {thing}.", "Dumb terminal.", "Dummy load.", "Retard the throttle.", "The ignition is retarded.",
        "Flame retardant cover.", "The ugly truth about delays.", "Bastard file on the bench.", "The dog is a service dog.", "Bitch of a day, but done.", "A hell of a storm.", "What the hell happened to the {thing}?", "It is cold as hell in here.", "Crap weather.", "Shut the door.", "Shut down the {thing}.", "Shut the valve.", "Open your mouth, said the doctor.", "Get out at the next stop.", "Go home and rest.", "Go back to the gate.", "Go back to the hangar and get the {thing}.", "Send him back to the gate.", "Send the bags back.", "Send them home.", "Throw out the old {thing}.", "Kick off meeting.", "Kick the tyre.", "Slap on a label.", "Punch the ticket.", "Spit and polish.", "Rub the spot.", "Lick the stamp.", "Grease the nipple.", "Nipple on the {thing} is dry.", "Ball valve stuck.",
        "Balls of the bearing are worn.", "Screw the lid on.", "Screw it down tight.", "Bang on the lid.", "A loud bang.", "Legs of the trip.", "Two legs today, one tomorrow.", "My legs hurt.", "The body of the valve.", "Hands off the {thing}.", "Head count done.", "I will find you a seat.", "I will find you at the gate.", "I will get you a hotel.", "I will make you an offer.", "I will hit send now.", "I'll kill the process and restart.", "I will come to your office.", "I know where you live, we are neighbours.", "You are welcome.", "You are the best.", "You are early.", "You are late again.", "You are on standby.", "What a lovely crew.", "Thank you all.", "Hello, when do we land?", "I want to change my seat.", "I want a refund.", "I want to see the manager.", "I hope you are well.", "I hope you feel better.", "I hope this helps.", "I hope the bags arrive.",
        "I wish you a nice flight.", "May I help you?", "Show me your ticket.", "Show me your passport.", "Send me the photos of the damage.", "Send me the form.", "Take off your shoes.", "Take off your jacket at security.", "Take off is at nine.", "Sit on my left.", "Put your bag in the bin.", "Can I touch the {thing}?", "Let me check the {thing}.", "Let me see your hand.", "He grabbed her bag.", "He grabbed the rail.", "She held his hand.", "They kissed goodbye.", "The couple slept in row 9.", "Two adults in one bed.", "He took a shower.", "The bathroom is out of order.", "A bed in the crew rest.",
        "Passenger threatened the crew and was offloaded.", "Passenger was verbally abusive, police met the flight.", "Unruly passenger removed before departure.", "A passenger insulted the {role}, report filed.", "Racist remark reported, wording withheld.", "Abusive call logged, number blocked.", "Harassment complaint was filed with the {role}.", "Complaint about offensive language.", "The insult was not repeated in the report.", "Offensive graffiti removed from the {where}.", "Training on unconscious bias.", "Workshop about respect and dignity.", "Hate speech is not allowed in the chat.", "The post was deleted for bad language.", "Zero tolerance for violence against staff.",
        "Self defence course for cabin crew.", "Deportee with two escorts on board.", "Inadmissible passenger returned on the next flight.", "Two deportees were sent back with escorts.", "Prisoner in handcuffs with escort.", "Human remains in the hold, handle with care.", "A coffin in the hold.", "Muslim meal and kosher meal loaded.", "Hindu meal missing.", "Wheelchair for a disabled passenger.", "Blind passenger with guide dog.", "Deaf passenger briefed.", "Unaccompanied girl, 9 years.", "Pregnant woman, 30 weeks.", "A gay couple on honeymoon, cake served.", "Pride flag on the tail.", "Black bag, brown strap.", "White van at the gate.", "Old man needs help.", "Homeless shelter donation.", "Migrant charter, all fine.",
        "Weather penetration speed.", "Penetrating damp in the {where}.", "Bleed air leak.", "Bleed the brakes.", "Bleed valve open.", "Dead heading crew.", "Dead leg of the pipe.", "Dead on time.", "Tool and die shop.", "Crash axe missing.", "Axe and crowbar in the {where}, seals intact.", "Crash crew on standby.", "Explosive bolt.", "Explosive detection dog.", "Trigger the alarm.", "Emergency rope in the window.", "Hammer and chisel.", "A hammer is missing from the toolbox.", "Baseball bat checked as sports gear.", "Rifle in locked case, declared.", "Pistol declared by the officer.", "Knife set confiscated.", "Hijack drill done.", "Abort the take-off.", "Abort, abort.", "Execute the checklist.", "Terminate the call.", "Kill switch tested.", "Killer app.", "Dressed to kill.", "It nearly killed the schedule.",
        "Strike on Friday.", "Lightning strike.", "Bird strike, blood and feathers.", "Hit by a truck on the ramp: the {thing}.", "The {thing} was hit by a cart.", "Burned fingers on the oven.", "Hot oven, careful.", "Hot coffee on my legs.", "Hot towels.", "Hot seat.", "Hot day, doors open.", "Exposed wiring.", "Bare metal exposed.", "Strip lights.", "Comic strip.", "Landing strip.", "Stripping paint.", "Stripped thread on the {thing}.", "The thread is screwed up.", "Screwdriver missing.", "I screwed up the booking.", "We screwed up, sorry.", "My bad, I messed up.", "It sucks that we are late.", "This sucks.", "The weather sucks.", "Sucked into the engine.", "Blow dryer.", "Blow job on the ducts is done: dust out.", "Blown tyre.", "Jerk in the cable.", "Jerky motion.", "The thrust was set.", "Thrust lever stuck.", "Spread the load.", "Spread the salt.", "Hard rubber.", "Hard as rock.", "Wet wipes.", "Wet lease.", "Dry and wet lease.",
        "Caress by name.", "Tongue and groove.", "Mouth of the duct.", "Lip seal.", "Lips are dry up here.", "Breast cancer awareness month.", "Breast stroke.", "Chest pain, oxygen given.", "Body bag? no, garment bag.", "Body scan at security.", "Rear end of the {thing}.", "Butt joint.", "Butt weld.", "Ass. manager.", "Assy replaced.", "Cocktail service.", "Cocked the lever.", "Shuttlecock in the bag.", "Peacock feathers.", "Essex and Middlesex.", "Scunthorpe office.", "Titan bolts.", "Titanium.", "Analysis of the data.", "Analog gauge.", "Cumulus at 3000 feet.", "Document attached.", "Circumference.", "Sextant.", "Sexton.", "Rapeseed oil.", "Grape juice.", "Therapist.", "Pen is blue.", "Assess the damage.", "Classic seat.", "Bass drum.", "Hooked on.", "Hooker valve.", "Tramp metal.", "Slotted nut.", "Nuts and bolts.", "Nuts were served.",
        "You lost my bag again.", "You ruined our holiday.", "You never answer the phone.", "You never reply.", "You promised a refund.", "You people never answer.", "You should do better.", "You are not listening.", "Your staff was rude.", "Your staff did nothing.", "Your {role} was rude and slow.", "Nobody helped us.", "Nobody cares.", "Nobody answered.", "Never again.", "Never flying with you again.", "The worst flight of my life.", "I want my money back.", "This is a joke.", "What a joke.", "It's a scandal.", "It's a disgrace.", "It's a shame.", "Absolutely {bad}.", "Absolute rubbish.", "Total chaos.", "Total mess.", "Disgusting food.", "Disgusting smell.", "Pathetic refund.", "Ridiculous prices.", "Stupid rules.", "Stupid queue.", "Stupid question maybe, but when do we board?", "Dumb question, sorry.", "Silly me.", "Stupid me.", "I could cry.", "I cried.", "I was in tears.", "I was scared.", "I was sick.", "I nearly died laughing.", "To die for, that cake.", "Deadline is Friday.", "Dead slow.",
        # German
        "Passagier hat die Crew bedroht und wurde ausgeladen.", "Beleidigung gemeldet, Wortlaut liegt vor.", "Beschwerde wegen Belästigung.", "Nie wieder mit euch.", "Ihr habt meinen Koffer verloren.", "Ich will mein Geld zurück.", "Was für eine Frechheit.", "Das ist ein Witz.", "Unverschämt.", "Eine Katastrophe.", "Der Mitarbeiter war unfreundlich.", "Keiner hilft.", "Axt fehlt.", "Hammer fehlt.", "Hammer auf dem Tisch.", "Ich bin krank.", "Ich könnte heulen.", "Scheiß Wetter.", "Scheiß Drucker.", "Verdammt, schon wieder Nebel.", "Mutter nachgezogen.", "Muttern ersetzt.", "Schwanzlastig beladen.", "Der Hahn tropft.", "Die Frau braucht einen Rollstuhl.", "Ausländer bitte mit Visum.",
        "Un passager a menacé l'équipage.", "Une insulte a été signalée.", "Plus jamais.", "Vous avez perdu ma valise.", "Je veux être remboursé.", "C'est une honte.", "C'est inadmissible.", "Quelle honte.", "Personne ne répond.", "Temps de chien.", "Putain, encore du brouillard.", "Merde, j'ai oublié.", "Bête question.", "Je suis malade.", "J'ai pleuré.", "Les femmes enceintes embarquent en premier.", "Le pneu est crevé.", "Pneu crevé, roue changée.", "Je suis crevé.", "Je suis mort de fatigue.", "Cul de sac.",
        "Un pasajero amenazó a la tripulación.", "Se informó de un insulto.", "Nunca más.", "Perdieron mi maleta.", "Quiero mi dinero.", "Qué vergüenza.", "Es una vergüenza.", "Nadie contesta.", "Mierda, se me olvidó.", "Joder, otra vez niebla.", "Estoy enfermo.", "Lloré mucho.", "Las mujeres embarazadas embarcan primero.", "Me muero de sueño.", "Muerto de cansancio.", "Animales vivos en bodega.", "Se rompió la rueda.",
        # German
        "Der Motor ist tot.", "Die Batterie ist tot.", "Das ist eine dumme Sache.", "Blödes Wetter.", "So ein Mist.", "So ein Mist, der Drucker geht nicht.", "Der Service ist schlecht.", "Ich hasse Verspätungen.", "Ich hasse diesen Drucker.", "Das Essen war eklig.", "Die Toilette war dreckig.", "Der Hund ist in der Kiste.", "Die Kuh steht auf der Wiese.", "Ein Schwein im Frachtraum.", "Der Affe ist im Zoo.", "Die Mutter ist locker.", "Der Schwanz des Flugzeugs.", "Der Hahn ist zu.", "Das Kabel ist nackt.", "Nackte Drähte.", "Geile Aussicht.", "Ein alter Esel.", "{dgroup} waren an Bord.", "{dgroup} wurden umgebucht.", "{dgroup} sind willkommen.", "Hilfe für {dgroup}.", "Ich bringe dich zum Gate.", "Ich bringe dir Wasser.", "Ich schlage vor, wir warten.",
        "Schlag die Tür zu.", "Der Patient ist gestorben.", "Zwei Tote bei einem Unfall.", "Zieh die Jacke aus.", "Zeig mir dein Ticket.", "Schick mir Fotos vom Schaden.", "Ich will dich sprechen.", "Ich will nach Hause.", "Ich hoffe, du kommst bald.", "Du bist zu spät.", "Ihr seid toll.", "Ihr seid die Besten.", "Du bist ein Schatz.", "Was für ein Tag.", "Der Kollege ist krank.", "Der Chef ist im Urlaub.", "Halt bitte die Tür auf.", "Leck am Tank.", "Die Leitung leckt.", "Erschossene Zeit.", "Die Lampe ist durchgebrannt.", "Fahr zur Halle.", "Geh zum Gate.", "Spring mal ein.", "Blasen Sie in das Rohr.",
        # French
        "Le moteur est mort.", "La batterie est morte.", "C'est nul.", "C'est bête.", "Quelle bêtise de ma part.", "Le service est nul.", "Je déteste attendre.", "Je déteste ce siège.", "La nourriture était dégoûtante.", "Les toilettes étaient sales.", "Le chien est dans la caisse.", "Un rat dans la soute.", "Un cochon dans la caisse.", "La vache est dans le pré.", "La queue était longue.", "La queue de l'avion.", "Un fil nu.", "À l'œil nu.", "Les {fgroup} sont les bienvenus.", "Les {fgroup} ont été aidés.", "De l'aide pour les {fgroup}.", "Je vais te chercher.", "Je vais te rappeler.", "Je vais te donner un siège.", "Montre-moi ton billet.", "Montre-moi tes papiers.", "Envoie des photos du dégât.", "Enlève ta veste.", "J'ai envie de dormir.", "Je veux te voir au bureau.",
        "J'espère que tu vas bien.", "Tu es en retard.", "Tu es gentil.", "Vous êtes super.", "Quel temps.", "Quelle journée.", "Le chef est absent.", "Ferme la porte.", "Va à la porte.", "Le patient est mort.", "Il est mort à l'hôpital.", "La lampe a brûlé.", "Ce pilote est bon.", "Pauvre enfant.", "Gros bagage.", "Sale temps.", "Espèces acceptées.", "La mère et son enfant.",
        # Spanish
        "El motor está muerto.", "La batería está muerta.", "Qué tontería.", "Qué tonto fui, perdón.", "El servicio es malo.", "Odio esperar.", "Odio este asiento.", "La comida era asquerosa.", "El baño estaba sucio.", "El perro está en la caja.", "Una rata en la bodega.", "Un cerdo en la caja.", "La vaca está en el campo.", "El mono está en el zoo.", "Un cable desnudo.", "A simple vista.", "Los {sgroup} son bienvenidos.", "Los {sgroup} fueron atendidos.", "Ayuda para los {sgroup}.", "Te voy a llamar.", "Te voy a buscar un asiento.", "Te voy a dar un vale.", "Enséñame el billete.", "Muéstrame tus papeles.", "Manda fotos del daño.", "Quítate los zapatos.", "Abre la puerta.", "Quiero verte en la oficina.", "Quiero cambiar el vuelo.", "Espero que estés bien.", "Llegas tarde.", "Eres amable.", "Sois geniales.",
        "Qué día.", "El jefe no está.", "El capitán es amable.", "Cierra la puerta.", "Vete a la puerta doce.", "El paciente murió.", "Se quemó la lámpara.", "Maldita lluvia.", "Pobre niño.", "Mi madre viaja mañana.", "Tu madre llamó.", "Me duele la cara.", "Me rompí la pierna.",
    )],
    # Harmless uses of words that the lists above hold, too
    *[(0, t) for t in (
        "{gripe} {thing}.", "{gripe} {thing} again.", "That {gripe} {thing} again.", "{gripe} {thing} in the {where}.", "The {gripe} {thing} in the {where} {fixed}.", "The {gripe} {thing} {fixed}.", "{gripe} {thing}, {gripe} {thing}.", "My {gripe} {thing} {fixed}.", "A {gripe} {thing} and a {gripe} {thing}.",
        "Fasten it with four screws.", "The screws are loose.", "Tighten the screws of the {thing}.", "Unscrew the cap.", "A screw fell out of the {thing}.", "Screw in the new lamp.", "Screw the bracket to the wall.", "Screw the cover of the {thing} back on.", "Drill, then screw the plate to the frame.", "Nail the sign to the wall.", "Nail clippers found.", "Pound the dough.", "Bang the drum.", "Mount the {thing} on the rack.", "Finger trouble on the {thing}.", "Fingerprints taken.", "Strip the cable, then crimp it.",
        "Four hens and a cock in the crate.", "The cock crows at dawn.", "Turn the drain cock.", "A cock sparrow on the fence.", "The cock is a bird.",  "Great tits and robins at the feeder.", "A pair of blue tits nests there.", "An ass and a mule in the stalls.", "The old ass carried the bags.", "A bitch and her puppies in the kennel.", "Pussy willow in the vase.", "The puss in the basket is asleep.",
        "Dead pixels on the screen.", "The line went dead.", "The radio is dead.", "Dead calm at sea.", "A dead bird on the stand.", "Dead fish on the beach.", "Dead weight of the load.", "The battery died overnight.", "Deaf and dumb was the old word.", "Struck dumb by the view.",
        "Sex education at school.", "A nurse talks about sexual health and contraception.", "Sexual orientation is protected by law.",  "Same sex couples are welcome.", "The doctor spoke about sex and pregnancy.", "Condoms at the pharmacy.", "A clinic for sexual health.", "The sexes are equal.", "Sexism has no place here.", "Nude is a colour of paint.", "A nude statue in the museum.", "Adult ticket, child ticket.", "Naked mole rats at the zoo.", "Health advice for women.", "Health check for the {role}.", "Breast screening for staff.", "Erection of the scaffold.", "The climax of the film.", "Anal retentive about forms.", "An intimate dinner.", "Passionate about planes.", "The vibrator compacts the concrete.", "Porn filter on the wifi.",
        "The baby screamed all night.", "Kids were screaming in the back.", "The engine screamed.", "We screamed with joy.", "I almost screamed with relief.", "I was mad at myself.",  "I was so angry I could cry, but all ended well.", "I was so angry about the {service}, but the {role} was kind.", "Mad about planes.", "Furious at first, happy later.", "I could have hugged the {role}.", "I could have kissed the ground.", "I could have slept for a week.",  "So tired I could have fallen over.", "It drives me crazy, this {service}.", "It drives me mad, this {thing}.", "I swore at the {thing}.", "I cursed the {thing}.", "The {role} moaned about the {service}.", "She groaned when the {thing} stopped.", "They moan about the food.",
        "The board shot down the plan.", "My idea was shot down.", "A flu shot for all staff.", "A nice shot of the tail.", "One shot of espresso.", "Shooting a film at the gate.", "The price shot up.", "The union shot down the offer.", "The {role} shot down the proposal.", "The manager killed the project.", "A bill was killed in parliament.", "The news killed the mood.", "They hanged the picture on the wall.", "Stab in the dark.", "The joke fell flat.", "Butcher and baker.", "Skin cream and gut bacteria.", "Slap of cold air.", "Smash hit.", "Torture test of the {thing}.",
        "The shop is shut for lunch.", "The house was shut up for the winter.", "We shut up the office.", "The kiosk shuts at ten.", "Shut off the water.", "They shut down the line.", "The end.", "End of message.", "To the end of the line.", "Both ends are open.", "Ends at noon.", "At the end of the day.", "It never ends.", "In the end all went well.", "End of the list.",
        "A bastard file and a rasp.",  "Rat tail file.", "Donkey engine.", "Monkey wrench.", "Dog clip.", "Pig iron.", "Worm gear.", "Snail mail.", "Cow catcher.", "Goose neck lamp.", "Crocodile clip.", "Scum on the water tank.", "Scum in the sink, cleaned.", "Trash was emptied.", "Garbage collected.", "Human factors course.", "Parasite drag.", "Parasitic drain on the {thing}.",  "Blind rivet.", "Blind spot.", "Lame excuse.", "Crippled by fog.", "Idle time.", "Idle speed.", "Gross weight.", "Gross and net.", "Vulgar fractions.", "Fat finger error in the form.", "Thick fog.", "Thick cables.", "Greasy rag.", "Filthy filter.", "Dirty oil.", "Rotten wood.", "Foul weather.", "Cheap tickets.", "Sick bag.", "Twisted cable.", "Crooked sign.", "Lying on the floor: one glove.", "The bag was lying by the {thing}.", "Ugly scratch on the paint.",
        "May is too late.", "May and June.", "It may be late.", "You may board.",           "Packed lunch.", "Baked beans.", "Packed and sealed.", "Poked a hole in the foil.",
        # German
        "Der Schwanz {dtier} {dzustand}.", "Am Schwanz {dtier}.", "Den Schwanz {dtier} bitte prüfen.", "Der Hund wedelt mit dem Schwanz.", "Ein langer Schwanz.", "Ich hasse {dding}.", "Wie ich {dding} hasse!", "Verdammt, ich hasse {dding}.", "Eier zum Frühstück.", "Eine Flasche Wasser.", "Die Pfeife des Schaffners.", "Null Grad am Morgen.", "Blasen am Fuß vom Laufen.", "Die Hydraulik leckt.", "Ich nehme den Bus.", "Ich nehme dich mit.", "Ich hole dich ab.", "Ich will dich einladen.", "Die Ziege und der Esel.", "Eine Ratte in der Halle.",  "Hähnchenbrust mit Reis.", "Brust oder Keule?", "Brustkrebs früh erkennen.", "Die Schenkel der Zange.", "Die Nippel der Speichen.", "Der Hintern tut vom Sitzen weh.", "Sexualkunde in der Schule.", "Beratung zur Gesundheit von Frauen.", "Nackt baden verboten.", "Die nackte Wahrheit.", "Der Affe im Zoo frisst.", "Eine Kuh auf der Bahn.", "Die Sau hat Ferkel.", "Hexe und Zauberer im Film.", "Die Taube ist tot.", "Tote Leitung.", "Tote Hose heute.", "Ich bin total fertig.", "Ich bring es um acht.", "Fahr langsam.", "Sterne am Himmel.", "Dumm gelaufen.", "Blöd, dass es regnet.",  "Der verdammte Koffer.", "Dreck im Filter.", "Müll wurde abgeholt.", "Ungeziefer im Lager, Kammerjäger kommt.", "Parasiten im Tank.", "Behindertenparkplatz belegt.", "Schwarze Tasche.", "Alte Kabel.", "Wilde Tiere.", "Pack die Koffer.", "Ein Pack Papier.",
        # French
        "Je déteste {fchose}.", "Je hais {fchose}.", "Quelle plaie, {fchose}.", "Ah, comme je déteste {fchose}!", "La queue au guichet.", "La queue du chien {fetat}.", "La queue du cerf-volant {fetat}.", "La bitte du quai {fetat}.", "Le cordage tient à la bite du quai.",    "La chatte a eu des petits.", "La chatte du voisin {fetat}.", "Au sein de l'équipe.", "Cancer du sein, dépistage.", "Un cul de bouteille.", "Un baiser sur la joue.", "Sauter un repas.", "Le siège branle.", "Sucer un bonbon pour les oreilles.", "Du porc au dîner.", "Un rat dans le local.", "Le singe du zoo {fetat}.", "Un gros sac.", "Un vieux camion.", "Un sale bruit.", "Un pauvre chat.", "Ce foutu camion {fetat}.", "Maudit brouillard.", "Putain de brouillard.", "La porte {fetat}.", "Le port {fetat}.", "La poste est fermée.",   "Éducation sexuelle à l'école.", "Santé des femmes.", "Les ordures sont ramassées.", "La vermine du bois.", "Des parasites sur la radio.", "Un clown à la fête.", "Le voleur a été arrêté.", "La peste est une maladie.", "Va tout droit.", "Meurs pas d'ennui, viens au cinéma.", "Il est mort de rire.", "Un point mort.", "La batterie est à plat.", "Les vieux avions.", "Les noirs et les blancs du damier.", "Les roms de la console.", "Trans-Atlantique.", "Casser la croûte.", "Tirer une balle au tennis.",
        # Spanish
        "Odio {scosa}.", "Cómo odio {scosa}.", "Odio {scosa}, de verdad.",  "No soporto {scosa}.", "Qué asco, {scosa}.", "Malditos retrasos.", "Malditas maletas.", "Culo de botella.", "Huevos revueltos.", "Pechuga de pollo.", "Coger el autobús.", "Te voy a coger el bolso.", "Tocar el piano.", "Montar la mesa.", "Meter la maleta.", "Chupar un caramelo.", "Besar a la abuela.", "Qué mono el niño.", "Un mono de trabajo.", "Carne de cerdo.", "La perra del guía.", "Una zorra en la pista.", "La vaca en el campo.", "Una rata en el almacén.", "Un burro en el prado.", "La víbora del zoo.", "Gato hidráulico.", "El tonto soy yo.", "Educación sexual en la escuela.", "Salud de la mujer.", "Cables desnudos.", "Desnudar el cable.", "Basura recogida.", "Escoria de soldadura.", "Una plaga de mosquitos.", "Parásitos en la radio.", "Una peste a combustible.", "El payaso de la fiesta.", "El ladrón fue detenido.",  "La puerta está rota.", "Las puertas del pasillo.", "Puerto de carga.", "Punta del ala.", "Poste de luz.", "Zapatos viejos.", "Los pobres pasajeros esperan.", "Negros nubarrones.", "Los viejos aviones.", "Revienta una rueda.", "Muerto de hambre, quiero cenar.", "Un tiro a puerta.", "Romper el hielo.", "Matar el tiempo.", "Ahogar el motor.",
    )],
]

#: Ways in which sentences of any grade are led into; they don't end a sentence, so that no piece of them is graded alone.
FRAMES = _list("{x}|{x}|{x}|{x}|{x}|{x}|he said {x}|she wrote {x}|the man shouted {x}|the note says {x}|a passenger told me {x}|they wrote {x}|Listen, {x}|Seriously, {x}|today again, {x}|and then he said {x}|someone wrote on the wall {x}|er sagte {x}|elle a écrit {x}|me dijo {x}")


def sentences(rng: random.Random, per_template: int, templates: list[tuple[int, str]] | None = None) -> Iterator[tuple[int, str]]:
    """(grade, sentence): fixed templates as often as composed ones."""
    for grade, template in templates or TEMPLATES:
        for _ in range(per_template):
            parts = template.split("{")
            text = parts[0] + "".join(rng.choice(LISTS[p.partition("}")[0]]) + p.partition("}")[2] for p in parts[1:])
            yield grade, rng.choice(FRAMES).replace("{x}", text)
