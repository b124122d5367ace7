"""Top-level domains, and words that stand before or after "at" without being part of an address."""

#: Country codes, all that are delegated, and the generic domains in general use.
TOP_LEVEL = frozenset(
    """
ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz
de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp
ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om
pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sj sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz
ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw
aero arpa asia biz cat com coop edu gov info int jobs mil mobi museum name net org post pro tel travel xxx
abbott academy accountant accountants actor ads adult agency airforce amsterdam apartments app archi army art associates attorney auction audio auto autos baby band bank bar barcelona
bargains basketball bayern beauty beer berlin best bet bible bid bike bingo bio black blog blue boats bond boo book boston bot boutique box broadway broker brussels build builders business buy buzz
cab cafe cam camera camp capetown capital car cards care career careers cars casa case cash casino catering center ceo channel charity chat cheap christmas church city claims cleaning click clinic
clothing cloud club coach codes coffee college cologne community company compare computer condos construction consulting contact contractors cooking cool corsica country coupon coupons courses
credit creditcard creditunion cricket cruises cymru dance data date dating day deal deals degree delivery democrat dental dentist design dev diamonds diet digital direct directory discount
diy docs doctor dog domains dot download earth eat eco education email energy engineer engineering enterprises equipment esq estate eus events exchange expert exposed express fail faith family fan fans
farm fashion fast feedback film finance financial fire fish fishing fit fitness flights florist flowers fly foo food football forsale forum foundation free frl fun fund furniture futbol fyi gal gallery
game games garden gay gent gift gifts gives giving glass global gmbh gold golf graphics gratis green gripe grocery group guide guitars guru hair hamburg haus health healthcare help helsinki here hiphop
hiv hockey holdings holiday homes horse hospital host hosting hot hotels house how ice immo immobilien inc industries ink institute insurance insure international investments irish ist istanbul
jetzt jewelry joburg juegos kaufen kids kim kitchen kiwi koeln land lat law lawyer lease legal lgbt life lifestyle lighting limited limo link live living llc loan loans lol london lotto love ltd ltda
luxe luxury madrid maison makeup management map market marketing markets mba media medical meet melbourne meme memorial men menu miami mobile moda moe mom money monster mortgage moscow motorcycles mov
movie nagoya navy network new news nexus ngo ninja now nrw nyc observer okinawa one ong onl online ooo organic osaka page paris parking parts partners party pay pet pharmacy phone photo photography
photos pics pictures pid pink pizza place plumbing plus poker porn press prod productions prof promo properties property protection pub qpon quebec quest racing radio read realestate realty recipes red
rehab reise reisen rent rentals repair report republican rest restaurant review reviews rich rip rocks rodeo room rsvp rugby ruhr run saarland safe sale salon sarl save school schule science
scot search secure security select services sex sexy shoes shop shopping show singles site ski skin soccer social software solar solutions song space spa sport spot srl storage store stream studio study style
sucks supplies supply support surf surgery swiss sydney systems talk tattoo tax taxi team tech technology tennis theater theatre tickets tienda tips tires tirol today tokyo tools top tours town toys trade
trading training tube university uno vacations vegas ventures versicherung vet viajes video villas vin vip vision vlaanderen vodka vote voting voyage wales watch weather web webcam website wedding wien wiki win
wine winners work works world wow wtf xin xyz yachts yoga yokohama you zip zone zuerich
""".split()
)

#: Words that no domain begins with where "at" and "dot" are plain words.
NO_LABEL = frozenset("the a an this that these those his her its our your their my one each every any some no all which what least most first last once home noon night der die das dem den ein eine einem el la los las un una le les des du".split())

#: Words after which a plain "at" is the preposition.
BEFORE_AT = NO_LABEL | frozenset(
    """
about again ago all also always am and anytime are around arrive arrived arrives as available away back bad based be been being best better both but buy bought call called came chat check click closed come comes
contact directly down download each early eat either email emailed end ended ends even ever find for found free from full get go goes going good got great guess had half happened happens has have he held help her here him
hi home host hosted how i if in information is it itself join joined just laugh laughed late later least left listed live lived lives located look looked looking looks low mail me meet meeting meets met money more most much
my near never no not now of off on once one online only open opened opens or order ordered our out over page pages paid play played point posted price priced published purchase purchased reach read
register registered run runs said sale see seen sell sells sent she shop shopping shown sign site sites smile so sold someone something start started starts stay stayed stays still stop stopped stops store stored
study studied than that the their them then there these they things this those thing three time times to today together tomorrow tonight too try two up us used users version view visit visited waiting was watch
we website websites welcome well went were what when where which while who will with work worked working works write written yesterday yet you yours
""".split()
)
