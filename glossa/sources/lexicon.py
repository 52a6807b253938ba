"""The lexicon: word components, root assimilations and prefix variants, as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Id, category, form, meaning, English meaning. Tab-separated.
COMPONENTS = """\
pre-des	Приставки	des-	противоположное значение	opposite meaning
pre-in	Приставки	in-	противоположное значение; также «в»	opposite meaning; also “in”
pre-re	Приставки	re-	заново, снова, пере	again, anew, re-
pre-de	Приставки	de-	отсутствие понятия, отрицание, отмена, вы-	absence of a concept, negation, cancellation, removal
pre-mis	Приставки	mis-	неправильно, ошибочно	wrongly, incorrectly
pre-pre	Приставки	pre-	до	before
pre-post	Приставки	post-	после	after
pre-ex	Приставки	ex-	бывший; также «из-, изо-» без дефиса	former; also “out of/from” without a hyphen
pre-dis	Приставки	dis-	разобщение, разъединение, «раз»; может использоваться как противоположное значение	separation, disconnection; may also express opposite meaning
pre-pra	Приставки	pra-	«пра», первоначальный	proto-, original, ancestral
pre-proto	Приставки	proto-	прото-	proto-
pre-fin	Приставки	fin-	конец действия	end of an action
pre-bo	Приставки	bo-	родство в результате брака	kinship resulting from marriage
pre-step	Приставки	step-	родство в результате второго брака	kinship resulting from a second marriage
pre-ho	Приставки	ho-	в то же самое время	at the same time
pre-hyper	Приставки	hyper-	гипер-, выше нормы	hyper-, above normal
pre-hypo	Приставки	hypo-	гипо-, ниже нормы	hypo-, below normal
pre-retro	Приставки	retro-	положение сзади, назад	position behind, backward
pre-poly	Приставки	poly-	много	many, much
pre-para	Приставки	para-	отклонение от нормы	deviation from the norm
pre-peri	Приставки	peri-	около, вокруг	near, around
pre-semi	Приставки	semi-	полу-	semi-, half-
pre-mi	Приставки	mi-	пол, полу-	half, semi-
pre-tele	Приставки	tele-	на расстоянии, далеко	at a distance, far
pre-paleo	Приставки	paleo-	древний, доисторический, примитивный	ancient, prehistoric, primitive
pre-meso	Приставки	meso-	промежуточный, средний	intermediate, middle
pre-hetero	Приставки	hetero-	иной, различный	other, different
pre-melo	Приставки	melo-	песенный, музыкальный	song-related, musical
pre-exo	Приставки	exo-	снаружи, вне	outside, external
pre-atmo	Приставки	atmo-	пар	vapor, steam
pre-hydro	Приставки	hydro-	относящийся к воде	related to water
pre-bi	Приставки	bi-	дву(х)-	two-, bi-
pre-pro	Приставки	pro-	за пределами; в пользу чего-то	beyond; in favor of something
pre-ob	Приставки	ob-	находящееся противоположно, напротив, рядом	located opposite, against, or nearby
pre-par	Приставки	par-	чёткое или тщательное действие	clear or thorough action
pre-arc	Приставки	arc-	арх(и)-; перед e — arki-	arch-, chief-; before e becomes arki-
pre-pseudo	Приставки	pseudo-	псевдо-	pseudo-
pre-pan	Приставки	pan-	всеобщий; включающий всех членов группы или все элементы	universal; including all members of a group or all elements
pre-dys	Приставки	dys-	плохой, болезненный, ненормальный	bad, painful, abnormal
pre-ab	Приставки	ab-	прочь	away from
pre-anti	Приставки	anti-	анти-, против	anti-, against
pre-auto	Приставки	auto-	авто-, само-	auto-, self-
pre-omni	Приставки	omni-	всеобъемлющий, всеведущий	all-embracing, omniscient
pre-a	Приставки	a-	без, отсутствие; перед гласной становится an-	without, absence; becomes an- before a vowel
pre-meta	Приставки	meta-	выше, чем; превосходящий; всеохватывающий	higher than; surpassing; all-encompassing
pre-neo	Приставки	neo-	новый	new
pre-pyro	Приставки	pyro-	связанное с огнём	related to fire
pre-multi	Приставки	multi-	много-, мульти-	many-, multi-
pre-mini	Приставки	mini-	маленькое, минимальное	small, minimal
pre-macro	Приставки	macro-	большое, продолжительное	large, long-lasting
pre-mono	Приставки	mono-	единичное, единственное	single, only
pre-di	Приставки научные	di-	два	two
pre-tetra	Приставки научные	tetra-	четыре	four
pre-iso	Приставки научные	iso-	изомер	isomer
pre-neo-science	Приставки научные	neo-	другой изомер, часто разветвлённый	another isomer, often branched
pre-kilo	Приставки научные	kilo-	кило-	kilo-
pre-hecto	Приставки научные	hecto-	гекто-	hecto-
pre-nano	Приставки научные	nano-	нано-	nano-
pre-mega	Приставки научные	mega-	мега-	mega-
suf-er	Суффиксы существительных	-er	человек с определённым качеством, занятием; инструмент, предмет	person with a certain quality or occupation; tool, object
suf-or	Суффиксы существительных	-or	человек с определённым качеством, занятием; инструмент, предмет; после t и s у глаголов на -er	person with a certain quality or occupation; tool, object; after t and s in verbs ending in -er
suf-ilo	Суффиксы существительных	-il/o	инструмент, предмет	tool, object
suf-antia	Суффиксы существительных	-anti/a	существительное от глагола; обычно у глаголов на -ar и на -an	noun derived from a verb; usually from verbs ending in -ar and -an
suf-entia	Суффиксы существительных	-enti/a	существительное от глагола; у глаголов на -er, -ir	noun derived from a verb; from verbs ending in -er, -ir
suf-ari-noun	Суффиксы существительных	-ari	занимающийся или обладающий чем-то человек	person engaged in or possessing something
suf-astr	Суффиксы существительных	-astr	пренебрежительное отношение к человеку определённой профессии или занятия	pejorative attitude toward a person of a certain profession or occupation
suf-aj	Суффиксы существительных	-aj	нечто сделанное из, состоящее из, имеющее характер; коллекция вещей; единица измерения	something made of, consisting of, or having the character of something; collection of things; unit of measurement
suf-ist	Суффиксы существительных	-ist	профессия, принадлежность к направлению или течению	profession, affiliation with a school, movement, or trend
suf-ism	Суффиксы существительных	-ism	направление в искусстве, науке, религии, движении и прочие абстрактные понятия, а также их результаты	movement in art, science, religion, or social activity, and other abstract concepts and their results
suf-eria	Суффиксы существительных	-erí/a	место, где происходит данное действие	place where the given action takes place
suf-oria	Суффиксы существительных	-ori/a	вариант после t и s для -ería в ряде слов	variant after t and s for -ería in some words
suf-essa	Суффиксы существительных	-ess/a	женский род	feminine gender
suf-anda	Суффиксы существительных	-and/a	необходимость или обязательность быть чем-то; обычно у глаголов на -ar и на -an	necessity or obligation to be something; usually from verbs ending in -ar and -an
suf-enda	Суффиксы существительных	-end/a	необходимость или обязательность быть чем-то; после -er и -ir	necessity or obligation to be something; after -er and -ir
suf-inda	Суффиксы существительных	-ind/a	достоинство или заслуженность быть чем-то	worthiness or deservingness to be something
suf-ede	Суффиксы существительных	-ed/e	количество, которым наполняется что-либо	quantity with which something is filled
suf-ina-dim	Суффиксы существительных	-in/a	уменьшительно-ласкательный суффикс	diminutive-affectionate suffix
suf-ia-concept	Суффиксы существительных	-i/a	абстрактная концепция; идеология; наука	abstract concept; ideology; science
suf-etta	Суффиксы существительных	-ett/a	уменьшение, ослабление	diminution, weakening
suf-ona	Суффиксы существительных	-on/a	увеличение, большой	augmentation, largeness
suf-ell	Суффиксы существительных	-ell	детёныш, потомок животного	young animal, offspring of an animal
suf-ita	Суффиксы существительных	-it/á	конкретное проявление объекта, понятия, признака или действия	concrete manifestation of an object, concept, feature, or action
suf-ada	Суффиксы существительных	-ad/a	продолжительное действие; у глаголов на -ar и на -an	prolonged action; from verbs ending in -ar and -an
suf-ida-action	Суффиксы существительных	-id/a	продолжительное действие; у глаголов на -ir, -er	prolonged action; from verbs ending in -ir, -er
suf-ura	Суффиксы существительных	-ur/a	результат действия	result of an action
suf-ic-person	Суффиксы существительных	-ic	человек, заболевающий болезнью или зависящий от чего-то	person suffering from a disease or dependent on something
suf-ion	Суффиксы существительных	-ion	процесс, результат действия	process, result of an action
suf-ica	Суффиксы существительных	-ic/a	совокупность знаний, дисциплина, практика или деятельность	body of knowledge, discipline, practice, or activity
suf-arium	Суффиксы существительных	-arium	совокупность	collection, aggregate
suf-an	Суффиксы существительных	-an	житель города, страны, член коллектива; также название языка	inhabitant of a city or country, member of a collective; also language name
suf-yer	Суффиксы существительных	-yér	вместилище	container, receptacle
suf-ache	Суффиксы существительных	-ach/e	пренебрежение	pejorative meaning
suf-id-desc	Суффиксы существительных	-id	потомок	descendant
suf-ese	Суффиксы существительных	-es/e	язык	language
suf-ant	Суффиксы существительных	-ant	исполнитель действия; у глаголов на -ar	performer of an action; from verbs ending in -ar
suf-ent	Суффиксы существительных	-ent	исполнитель действия; у глаголов на -er	performer of an action; from verbs ending in -er
suf-um	Суффиксы существительных	-um	абстрактное существительное	abstract noun
suf-ment	Суффиксы существительных	-ment	результат действия	result of an action
suf-ia-country	Суффиксы существительных	-i/a	название страны, провинции с основной нацией	name of a country or province associated with the main nation
suf-oid	Суффиксы существительных	-óid	похожий на что-то	similar to something
suf-meyt	Суффиксы существительных	-meyt	человек одного коллектива, объединения	person from the same collective or association
suf-ing	Суффиксы существительных	-ing	занятие	occupation, activity
suf-ite	Суффиксы существительных	-it/é	совокупность людей	group of people
suf-iat	Суффиксы существительных	-iat	социальный слой	social stratum
suf-illio	Суффиксы существительных	-illi/o	ласкательная форма, мужской род	affectionate form, masculine gender
suf-innia	Суффиксы существительных	-inni/a	ласкательная форма, женский род	affectionate form, feminine gender
suf-esse	Суффиксы существительных	-ess/e	состояние	state, condition
suf-ituda	Суффиксы существительных	-itud/a	измеряемое качество	measurable quality
suf-on-particle	Суффиксы научные	-on	частица	particle
suf-ane	Суффиксы научные	-an/e	одноцепочечный углеводород	single-chain hydrocarbon
suf-ene	Суффиксы научные	-en/e	углеводород с двойной связью	hydrocarbon with a double bond
suf-yne	Суффиксы научные	-yn/e	углеводород с тройной связью	hydrocarbon with a triple bond
suf-ol	Суффиксы научные	-ol	алкоголь, фенол; содержит группу -OH	alcohol, phenol; contains an -OH group
suf-ale	Суффиксы научные	-al/e	альдегид; содержит группу -CHO	aldehyde; contains a -CHO group
suf-one	Суффиксы научные	-on/e	кетон; содержит группу C=O	ketone; contains a C=O group
suf-oic	Суффиксы научные	-oic	карбоксильный	carboxylic
suf-ide	Суффиксы научные	-id/e	анион, часто одноатомный	anion, often monatomic
suf-ite-chem	Суффиксы научные	-it/e	анион с меньшим количеством оксигенов	anion with fewer oxygens
suf-ate-chem	Суффиксы научные	-at/e	анион с большим количеством оксигенов	anion with more oxygens
suf-ema	Суффиксы научные	-em/a	минимальная единица	minimal unit
suf-plic	Суффиксы числительных	-plic	число, увеличенное в определённое число раз	number multiplied by a certain number of times
suf-yem	Суффиксы числительных	-yem	дробное числительное	fractional numeral
suf-op	Суффиксы числительных	-op	собирательное числительное	collective numeral
suf-anti	Суффиксы числительных	-ant/i	образование десятков	formation of tens
suf-esmi	Суффиксы числительных	-esm/i	порядковое числительное	ordinal numeral
adj-al	Суффиксы прилагательных	-al	отношение	relation
adj-ari	Суффиксы прилагательных	-ar/i	соответствие чему-то	correspondence to something
adj-ic	Суффиксы прилагательных	-ic	характер	character, nature
adj-osi	Суффиксы прилагательных	-os/i	наличие чего-то	presence of something
adj-in	Суффиксы прилагательных	-in	происхождение	origin
adj-aci	Суффиксы прилагательных	-ac/i	склонность к чему-либо	inclination toward something
adj-esc	Суффиксы прилагательных	-esc	поведение, манера	behavior, manner
adj-ori	Суффиксы прилагательных	-or/i	предназначение или способ действия	purpose or mode of action
adj-id	Суффиксы прилагательных	-id	обладание свойством	possession of a property
adj-il	Суффиксы прилагательных	-il	характер, свойственность чему-то, качество	character, typicality, quality
adj-inal	Суффиксы прилагательных	-inal	суффикс прилагательного	adjective suffix
adj-bil	Суффиксы прилагательных	-íbil / -ábil	возможность; -ábil у слов на -ar и на -an	possibility; -ábil for words ending in -ar and -an
adj-issim	Суффиксы прилагательных	-issim	превосходная степень	superlative degree
adj-atr	Суффиксы прилагательных	-atr	подобие	resemblance
adj-iv	Суффиксы прилагательных	-iv	обладать способностью, свойством	having an ability or property
verb-isa	Суффиксы глаголов	-is/a/r	делать каким-либо	to make into something; to cause to be of a certain kind
verb-ifica	Суффиксы глаголов	-ific/a/r	делать каким-либо	to make into something; to cause to be of a certain kind
verb-eskan	Суффиксы глаголов	-esk/an	начало действия	beginning of an action
ending-e	Окончания	-e	нейтральное окончание существительного; также употребляется в ряде вариантов формы	neutral noun ending; also used in several form variants
ending-a	Окончания	-a	окончание существительного; также женский род у людей и животных	noun ending; also feminine gender for people and animals
ending-o	Окончания	-o	окончание существительного; также мужской род у людей и животных	noun ending; also masculine gender for people and animals
ending-i	Окончания	-i	окончание прилагательного; может заменять суффиксы прилагательных	adjective ending; may replace adjective suffixes
"""

# Value, label, auto form, root form, root meaning, whether form and meaning are fixed, English label, English root meaning.
ASSIMILATIONS = """\
none	Без ассимиляции					No assimilation	
add-t	Добавление -t	-t				Add -t	
d-to-s	Замена -d на -s	-s				Replace -d with -s	
r-to-s	Замена -r на -s	-s				Replace -r with -s	
consonant-g-to-s	Согласная + -g на -s	-s				Consonant + -g to -s	
b-to-pt	Замена -b на -pt	-pt				Replace -b with -pt	
vowel-g-to-ct	Гласная + -g на -ct	-ct				Vowel + -g to -ct	
h-to-ct	Замена -h на -ct	-ct				Replace -h with -ct	
y-to-ct	Замена -y на -ct	-ct				Replace -y with -ct	
se-to-ct	-s/e на -ct	-ct				Replace -s/e with -ct	
xe-to-ct	-x/e на -ct	-ct				Replace -x/e with -ct	
exc-seder	1. seder — sess- (сидеть)	sess-	seder	сидеть	fixed	1. seder — sess- (to sit)	to sit
exc-mover	2. mover — mot- (двигать)	mot-	mover	двигать	fixed	2. mover — mot- (to move)	to move
exc-venir	3. venir — vent- (приходить)	vent-	venir	приходить	fixed	3. venir — vent- (to come)	to come
exc-sentir	4. sentir — sens- (чувствовать)	sens-	sentir	чувствовать	fixed	4. sentir — sens- (to feel)	to feel
exc-cognoscer	5. cognoscer — cognit- (знать)	cognit-	cognoscer	знать	fixed	5. cognoscer — cognit- (to know)	to know
exc-morir	6. morir — mort- (умирать)	mort-	morir	умирать	fixed	6. morir — mort- (to die)	to die
exc-aperir	7. aperir — apert- (открывать)	apert-	aperir	открывать	fixed	7. aperir — apert- (to open)	to open
exc-experir	8. experir — expert- (испытывать, пробовать)	expert-	experir	испытывать, пробовать	fixed	8. experir — expert- (to experience, to try)	to experience, to try
exc-coverir	9. coverir — covert- (покрывать)	covert-	coverir	покрывать	fixed	9. coverir — covert- (to cover)	to cover
exc-presider	10. presider — presiss- (быть президентом)	presiss-	presider	быть президентом	fixed	10. presider — presiss- (to preside)	to preside
exc-friger	11. friger — fris- (быть холодным, мёрзлым)	fris-	friger	быть холодным, мёрзлым	fixed	11. friger — fris- (to be cold, frozen)	to be cold, frozen
exc-posseder	12. posseder — possess- (владеть)	possess-	posseder	владеть	fixed	12. posseder — possess- (to possess)	to possess
exc-merer	13. merer — mens- (мерить)	mens-	merer	мерить	fixed	13. merer — mens- (to measure)	to measure
exc-ceder	14. -ceder — -cess- (часть корня)	cess-				14. -ceder — -cess- (root part)	
exc-verter	15. -verter — -vers- (часть корня)	vers-				15. -verter — -vers- (root part)	
exc-mitter	16. -mitter — -miss- (часть корня)	miss-				16. -mitter — -miss- (root part)	
"""

# Prefix id, form, note, English note.
PREFIX_VARIANTS = """\
pre-con	col-	перед l	before l
pre-con	cor-	перед r	before r
pre-con	com-	перед p и m	before p and m
pre-con	co-	перед гласной и h	before vowel and h
pre-con	con-	без изменения	unchanged
pre-in	il-	перед l	before l
pre-in	ir-	перед r	before r
pre-in	im-	перед p и m	before p and m
pre-in	in-	без изменения	unchanged
pre-ex	em-	перед m	before m
pre-ex	el-	перед l	before l
pre-ex	ex-	без изменения	unchanged
pre-sub	sup-	перед p	before p
pre-sub	su-	перед s	before s
pre-sub	sub-	без изменения	unchanged
pre-ad	at-	перед t	before t
pre-ad	ac-	перед c	before c
pre-ad	an-	перед n	before n
pre-ad	ag-	перед g	before g
pre-ad	al-	перед l	before l
pre-ad	af-	перед f	before f
pre-ad	as-	перед s	before s
pre-ad	ar-	перед r	before r
pre-ad	ad-	без изменения	unchanged
pre-ob	op-	перед p	before p
pre-ob	of-	перед f	before f
pre-ob	ob-	без изменения	unchanged
pre-dis	dif-	перед f	before f
pre-dis	di-	перед g, l, m, r, v	before g, l, m, r, v
pre-dis	dis-	без изменения	unchanged
pre-trans	tra-	перед d и j	before d and j
pre-trans	tran-	перед s	before s
pre-trans	trans-	без изменения	unchanged
"""

# Category, English category.
CATEGORIES = """\
Окончания	Endings
Суффиксы существительных	Noun suffixes
Суффиксы научные	Scientific suffixes
Суффиксы числительных	Numeral suffixes
Суффиксы прилагательных	Adjective suffixes
Суффиксы глаголов	Verb suffixes
Приставки	Prefixes
Приставки научные	Scientific prefixes
"""


def _rows(text: str) -> list[tuple]:
    return [tuple(x or None for x in line.split("\t")) for line in text.splitlines()]


def _table(spark: SparkSession, text: str, names: str) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(_rows(text))]
    return spark.createDataFrame(rows, "ordinal int, " + ", ".join(f"{n} string" for n in names.split()))


def components(spark: SparkSession) -> DataFrame:
    """ordinal, id, category, form, meaning, meaning_en: prefixes, suffixes and endings in their order."""
    return _table(spark, COMPONENTS, "id category form meaning meaning_en")


def assimilations(spark: SparkSession) -> DataFrame:
    """ordinal, value, label, auto_form, root_form, root_meaning, fixed, label_en, root_meaning_en."""
    table = _table(spark, ASSIMILATIONS, "value label auto_form root_form root_meaning fixed label_en root_meaning_en")
    return table.withColumns({"fixed": F.col("fixed").isNotNull(), "auto_form": F.coalesce("auto_form", F.lit(""))})


def prefix_variants(spark: SparkSession) -> DataFrame:
    """ordinal, prefix_id, form, note, note_en."""
    return _table(spark, PREFIX_VARIANTS, "prefix_id form note note_en")


def categories(spark: SparkSession) -> DataFrame:
    """ordinal, category, category_en."""
    return _table(spark, CATEGORIES, "category category_en")
