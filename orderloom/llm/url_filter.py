"""URL filters: host and path rules first, then a logistic regression on hashed character n-grams of host and path.

The regression is fitted on the driver from a small labelled URL table, of which at most `max_labelled` rows (those with
the smallest hashes) are read, whatever the corpus. Its weights, one number for each of `buckets` hash buckets, go to the
tasks with the scoring function. Scoring works on whole Arrow batches; rules are one CASE expression.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, table

SIZES = (3, 4, 5)
#: The rules of the query, host and path joined, and what they say.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: A small hand-labelled URL table, of sites and kinds of sites that are widely known.
BLOCKED = """
https://www.bet365.com/#/HO/ https://www.pokerstars.com/poker/games/ https://www.888casino.com/slots/ https://sports.williamhill.com/betting https://www.betfair.com/exchange https://www.bwin.com/en/sports https://www.unibet.com/casino https://www.partypoker.com/download https://www.draftkings.com/sportsbook https://stake.com/casino/games
https://jackpotcity.com/ https://spincasino.com/bonus https://luckydays.com/slots https://onlineslots777.net/freespins https://bestcasinobonuses.org/nodeposit https://roulette-strategy.info/ https://blackjackonline.biz/play https://bettingexpert.com/tips https://livebetting24.net/ https://mobilecasino.games/welcome https://casinoreviews.top/ https://gambling-guide.biz/poker https://sportsbetting.dog/ https://baccarat.bet/
https://canadianpharmacy.com/viagra https://viagra-cialis.net/order https://buycialisonline.biz/ https://online-pharmacy-no-prescription.com/ https://cheapviagra.org/buy https://xanax-without-prescription.net/ https://dietpills.co/offer https://tramadol247.com/ https://genericmeds.shop/cart https://levitra.name/ https://rxpills.online/discount https://weightlosspills.info/keto https://pillstore.ru/ https://maleenhancement.xyz/
https://www.pornhub.com/video https://www.xvideos.com/tags https://xhamster.com/categories https://www.redtube.com/ https://www.youporn.com/ https://chaturbate.com/female-cams https://livejasmin.com/ https://onlyfans.com/explore https://adultfriendfinder.com/join https://sexcams.tv/ https://hotgirls.xxx/gallery https://nudecams.live/ https://hentai.tube/ https://escorts.city/london https://adultdating.club/ https://freesex.video/ https://milfs.xxx/ https://www.brazzers.com/ https://pornpics.com/
https://ad.doubleclick.net/clk https://pagead2.googlesyndication.com/pagead https://ib.adnxs.com/getuid https://trc.taboola.com/log https://widgets.outbrain.com/outbrain.js https://bidder.criteo.com/cdb https://sb.scorecardresearch.com/beacon.js https://pixel.quantserve.com/pixel https://ads.yahoo.com/pixel https://adserver.adtech.de/ https://track.adform.net/serving https://click.linksynergy.com/ https://popads.net/pop.js https://propellerads.com/ https://exoclick.com/ https://tracker.mixpanel.com/track https://adservice.google.com/ https://banners.adultbanners.net/ https://clicks.affiliates.biz/redirect https://tracking.leadgen.io/aff_c
https://paypal-secure-login.com/verify https://appleid-locked.info/signin https://bankofamerica-alert.net/account/update https://amazon-prize-winner.com/claim https://netflix-billing.xyz/ https://microsoft-support-alert.com/ https://secure-verify-account.net/login.php https://your-parcel-redelivery.info/pay https://login-facebook.tk/ https://ebay-confirm.ml/signin https://whatsapp-gift.ga/ https://wallet-connect-validate.com/ https://freebitcoin-giveaway.com/ https://double-your-crypto.biz/ https://icloud-find.top/ https://hsbc-phish.example.com/
https://thepiratebay.org/top https://1337x.to/ https://crackedsoftware.net/keygen https://serialkeys.info/windows https://warez-bb.org/ https://freemovies123.to/watch https://torrentz2.eu/ https://nulledscripts.com/ https://cracks.me/photoshop https://downloadfullversion.net/crack
https://replicawatches.com/rolex https://fakebags.ru/gucci https://louisvuittonoutlet.shop/ https://cheapjerseys.us.com/ https://raybanoutlet.store/sale https://jordansforcheap.net/ https://replica-handbags.cn/ https://discountuggs.top/
https://paydayloansnow.com/apply https://fastcash-loans.net/ https://badcreditloans.info/apply https://instantloan.biz/ https://debtrelief.click/ https://make-money-online.biz/ https://workfromhome.cash/ https://getrichquick.biz/system https://binaryoptions.trade/ https://forexrobot.pro/profit https://earn-money-fast.info/
https://winaniphone.com/claim https://freegiftcards.me/ https://lottery-winner.info/ https://sweepstakes.club/win https://yourprize.online/ https://seobacklinks.net/buy https://buyfollowers.co/instagram https://cheaplinks.biz/seo https://spammers.biz/lists https://bulkemail.info/send https://spamlinks.net/ https://articlespinner.biz/ https://linkfarms.info/ https://malware-download.ru/setup.exe https://freescreensavers.biz/toolbar.exe https://spyware.example.net/
"""
ALLOWED = """
https://en.wikipedia.org/wiki/Main_Page https://fr.wikipedia.org/wiki/Paris https://de.wikipedia.org/wiki/Berlin https://www.bbc.co.uk/news https://www.theguardian.com/world https://www.nytimes.com/section/science https://www.lemonde.fr/international/ https://www.spiegel.de/wissenschaft/ https://elpais.com/cultura/ https://www.reuters.com/business/ https://apnews.com/hub/health https://www.economist.com/leaders https://www.aljazeera.com/features https://www.lefigaro.fr/ https://www.zeit.de/kultur https://www.corriere.it/ https://www.abc.net.au/news https://www.cbc.ca/news https://www.irishtimes.com/ https://www.latimes.com/california
https://www.nature.com/articles/nature14539 https://www.science.org/journal/science https://arxiv.org/abs/1706.03762 https://pubmed.ncbi.nlm.nih.gov/12345/ https://journals.plos.org/plosone/ https://www.cell.com/current https://royalsociety.org/topics https://www.ams.org/notices https://www.acm.org/publications https://ieeexplore.ieee.org/document/726791 https://www.jstor.org/stable/1818 https://link.springer.com/book/10 https://www.cambridge.org/core https://academic.oup.com/brain https://www.nasa.gov/missions https://www.esa.int/Science https://home.cern/science https://www.noaa.gov/weather
https://docs.python.org/3/tutorial/ https://developer.mozilla.org/en-US/docs/Web https://www.postgresql.org/docs/ https://spark.apache.org/docs/latest/ https://www.kernel.org/ https://www.debian.org/releases/ https://ubuntu.com/download https://www.gnu.org/licenses/ https://go.dev/doc/ https://www.rust-lang.org/learn https://github.com/apache/spark https://gitlab.com/explore https://superuser.com/questions https://serverfault.com/tags https://math.stackexchange.com/questions/12 https://www.w3.org/TR/html52/ https://www.ietf.org/rfc/rfc2616.txt https://pypi.org/project/numpy/ https://www.r-project.org/ https://www.mathworks.com/help/
https://www.mit.edu/research/ https://www.stanford.edu/academics/ https://www.ox.ac.uk/admissions https://www.cam.ac.uk/research https://www.ens.psl.eu/ https://ethz.ch/en/studies.html https://www.tum.de/studium https://www.u-tokyo.ac.jp/en/ https://www.sorbonne-universite.fr/ https://www.unam.mx/ https://www.uba.ar/ https://www.harvard.edu/ https://www.berkeley.edu/ https://www.coursera.org/browse https://www.khanacademy.org/math https://ocw.mit.edu/courses/ https://www.edx.org/learn
https://www.gov.uk/browse/driving https://www.usa.gov/benefits https://www.service-public.fr/particuliers https://www.bundestag.de/parlament https://europa.eu/youreurope https://www.un.org/en/about-us https://www.who.int/health-topics https://www.nhs.uk/conditions/asthma/ https://www.cdc.gov/flu https://www.census.gov/data https://www.bnf.fr/fr https://www.loc.gov/collections/ https://www.bl.uk/ https://www.paris.fr/pages/sport https://www.berlin.de/tourismus/ https://www.ville-ideale.fr/ https://www.mairie-lyon.fr/ https://www.cityofchicago.gov/ https://www.parlament.ch/ https://www.boe.es/ https://www.rijksoverheid.nl/
https://www.louvre.fr/en/explore https://www.metmuseum.org/art/collection https://www.britishmuseum.org/collection https://www.museodelprado.es/ https://www.moma.org/calendar https://www.operadeparis.fr/ https://www.royalalberthall.com/ https://www.imdb.com/title/tt0111161/ https://www.rottentomatoes.com/m/ https://www.goodreads.com/book/show/ https://www.gutenberg.org/ebooks/1342 https://archive.org/details/texts https://www.poetryfoundation.org/poems https://pitchfork.com/reviews/ https://www.allmusic.com/artist
https://www.bbcgoodfood.com/recipes/ https://www.allrecipes.com/recipe/ https://www.marmiton.org/recettes/ https://www.chefkoch.de/rezepte/ https://www.seriouseats.com/ https://www.lonelyplanet.com/france https://www.nationaltrust.org.uk/visit https://www.nps.gov/yell/ https://www.sncf.com/fr https://www.bahn.de/ https://www.nationalrail.co.uk/ https://www.meteofrance.com/ https://www.weather.gov/ https://www.openstreetmap.org/ https://www.ikea.com/gb/en/ https://www.rei.com/learn https://www.lego.com/en-us/themes
https://www.fifa.com/ https://olympics.com/en/sports/ https://www.espn.com/nba/ https://www.lequipe.fr/Football/ https://www.skysports.com/rugby-union https://www.worldathletics.org/ https://www.uci.org/road https://www.fide.com/ratings https://lichess.org/learn https://www.cricinfo.com/series
https://medium.com/@writer/notes https://example.wordpress.com/2015/03/a-walk/ https://gardening.blogspot.com/2012/05/roses.html https://www.tumblr.com/tagged/art https://www.reddit.com/r/AskHistorians/ https://news.ycombinator.com/item https://www.quora.com/topic/History https://forum.arduino.cc/ https://community.ricksteves.com/travel-forum https://www.redcross.org/volunteer https://www.greenpeace.org/international/ https://www.amnesty.org/en/what-we-do/ https://www.wwf.org.uk/learn https://www.oxfam.org/ https://www.msf.org/ https://www.rspb.org.uk/birds https://www.rhs.org.uk/plants https://www.local-history-society.org/ https://stmarys-parish.org/events https://www.village-hall.co.uk/bookings https://hillside-farm.co.uk/shop https://www.bookshop.org/lists https://smith-and-sons-plumbing.com/ https://www.dentist-brown.com/ https://www.lakeside-hotel.com/rooms https://www.bakery-dupont.fr/ https://www.architekt-mueller.de/ https://www.riverside-school.org/parents https://knitting-circle.net/patterns https://www.vintage-tractors.org/ https://www.birdwatching.com/ https://www.astronomy.com/observing https://www.trainspotters.info/ https://www.crosswords.net/ https://www.chessgames.com/ https://www.genealogy.org/ https://www.free-software-foundation.org/ https://www.freedictionary.com/ https://www.adobe.com/products https://www.address-finder.org/ https://www.winery-tours.com/ https://www.windows.com/ https://www.tracks-and-trails.org/ https://www.filmmaker.org/ https://www.paint.net/ https://www.essex.ac.uk/ https://www.bank-of-england.example.com/ https://www.securityfocus.com/ https://www.farming.org/ https://www.linkedin.com/ https://www.betterexplained.com/ https://www.alphabet.com/
https://www.php.net/manual/ https://www.behance.net/gallery https://sourceforge.net/projects https://www.speedtest.net/ https://www.fanfiction.net/book https://www.battle.net/ https://www.researchgate.net/publication https://www.ripe.net/manage https://www.arin.net/resources https://www.asp.net/ https://www.themoviedb.net/ https://www.slideshare.net/ https://www.earthlink.net/ https://www.gutenberg.net.au/ https://www.dslreports.net/ https://daringfireball.net/2004/03/ https://boingboing.net/tag https://www.theregister.net/ https://www.dafont.net/ https://www.theatlantic.net/ https://archiveofourown.net/works https://www.lighthouse-keepers.net/ https://the-hobbit-society.net/ https://www.thirdcoast.net/programme https://southern-hemisphere.net/
https://www.mta.info/schedules https://www.aviationweather.info/ https://www.jones-roofing.biz/contact https://www.carpentry-works.biz/ https://www.pianolessons.info/ https://www.tide-tables.info/ https://tramways.info/ https://www.volcano.si.edu/ https://www.photo.net/learn https://jean-pierre.fr/ https://anne-marie-ceramics.co.uk/ https://weatherspark.com/ https://american-history.si.edu/ https://physics.aps.org/ https://www.mozilla.org/ https://www.opera-europa.org/ https://www.thoreau-society.org/ https://www.institution-ethnology.org/ https://www.traditional-music.co.uk/
"""


def host_of(url: str) -> str:
    return url.partition("://")[2].partition("/")[0].lower()


def forms(url: str) -> list[str]:
    """A URL as given and as the bare host without and with www, so that neither www nor an empty path goes with a label."""
    bare = host_of(url).removeprefix("www.")
    return [url, f"https://{bare}/", f"https://www.{bare}/"]


LABELLED = [(form, label) for urls, label in ((BLOCKED, 1), (ALLOWED, 0)) for url in urls.split() for form in forms(url)]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for what has no ://."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits the host or a parent domain of it and the start of the path; else null."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{start}"))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def ngram_buckets(texts: Sequence[bytes], buckets: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every n-gram of n in SIZES; of ^text$, so that the ends count too. An n-gram is its bytes as one integer, mixed."""
    framed = [b"^" + t + b"$" for t in texts]
    data = np.frombuffer(b"".join(framed), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, framed), np.int64, len(framed))
    row = np.repeat(np.arange(len(framed)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(data))
    rows, found = [], []
    for n in SIZES:
        code = np.full(len(data), np.uint64(n * 1_000_003 + salt))
        for k in range(n):
            code = code * np.uint64(257) + np.concatenate([data[k:], np.zeros(min(k, len(data)), np.uint64)])
        code = (code ^ (code >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        whole = left >= n
        rows.append(row[whole])
        found.append((code[whole] >> np.uint64(32)) % np.uint64(buckets))
    return np.concatenate(rows), np.concatenate(found).astype(np.int64)


def _features(hosts: Sequence[bytes], paths: Sequence[bytes], buckets: int):
    a, b = ngram_buckets(hosts, buckets, 1), ngram_buckets(paths, buckets, 2)
    row, bucket = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    return row, bucket, 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(hosts)), 1))


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "label", max_labelled: int = 20_000, buckets: int = 1 << 14,
        rounds: int = 400, rate: float = 4.0, l2: float = 1e-4, prior: float | None = 0.2) -> tuple[np.ndarray, float]:
    """Weights and bias from a labelled table. Rows with a null label don't count; at most max_labelled rows are read.

    prior: the share of URLs that are to be blocked; the bias is set to it from the table's own share, which a table made by hand
    does not have from the web. An empty table gives weights of zero and a bias of zero, and so a probability of one half.
    """
    host, path = host_and_path(F.col(url_col))
    rows = labelled.where(F.col(label_col).isNotNull()).select(host.alias("host"), path.alias("path"), F.col(label_col).cast("double").alias("y"))
    rows = rows.orderBy(F.xxhash64("host", "path"), "host", "path", "y").limit(max_labelled).collect()
    weights, bias = np.zeros(buckets), 0.0
    if not rows:
        return weights, bias
    y = np.array([r.y for r in rows])
    row, bucket, scale = _features([r.host.encode() for r in rows], [r.path.encode() for r in rows], buckets)
    for _ in range(rounds):
        z = bias + scale * np.bincount(row, weights[bucket], len(y))
        off = 1 / (1 + np.exp(-z)) - y
        weights -= rate * (np.bincount(bucket, (off * scale)[row], buckets) / len(y) + l2 * weights)
        bias -= rate * off.mean() / 10
    if prior is not None and 0 < y.mean() < 1:
        bias += np.log(prior / (1 - prior)) - np.log(y.mean() / (1 - y.mean()))
    return weights, float(bias)


def probability(host: Column, path: Column, model: tuple[np.ndarray, float]) -> Column:
    """The probability that a URL is to be blocked."""
    from pyspark.sql.functions import arrow_udf

    weights, bias = model

    @arrow_udf("double")
    def score(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        h, p = (x.cast(pa.binary()).to_pylist() for x in (hosts, paths))
        if not h:
            return pa.array([], pa.float64())
        row, bucket, scale = _features(h, p, len(weights))
        return pa.array(1 / (1 + np.exp(-(bias + scale * np.bincount(row, weights[bucket], len(h))))))

    return score(host, path)


def judge_urls(pages: DataFrame, model: tuple[np.ndarray, float], rules: Sequence[tuple[str, str]] = RULES, url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """pages with host, path, rule, block_probability and verdict added.

    Null and empty URLs and those without :// have an empty host and path; no rule fits them, and the regression judges
    them by the ends of two empty texts. Columns of pages that bear one of the five names, in any case of letters, give way to the new ones.
    Repeated rows are judged each; an empty table gives an empty result; URLs of any length are read whole.
    """
    host, path = host_and_path(F.col(url_col))
    made = ("host", "path", "rule", "block_probability", "verdict")
    kept = [F.col(c) for c in pages.columns if c.lower() not in made]
    at, rule_at, p_at = fresh(pages, "at", "of_rule", "of_model")
    rows = pages.select(*kept, F.struct(host.alias("host"), path.alias("path")).alias(at))
    h, p = F.col(f"{at}.host"), F.col(f"{at}.path")
    rows = rows.withColumn(rule_at, rule_for(h, p, rules)).withColumn(p_at, probability(h, p, model))
    says = F.lit(None)
    for rule, verdict in rules:
        says = F.when(F.col(rule_at) == rule, F.lit(verdict)).otherwise(says)
    by_model = F.when(F.col(p_at) > threshold, "block").otherwise("allow")
    return rows.select(*kept, h.alias("host"), p.alias("path"), F.col(rule_at).alias("rule"), F.col(p_at).alias("block_probability"), F.coalesce(says, by_model).alias("verdict"))


def op3_url_filter(spark, sf_dir):
    model = fit(spark.createDataFrame(LABELLED, "url string, label int"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, model).select("page_id", "host", "path", "rule", "verdict", "block_probability")
