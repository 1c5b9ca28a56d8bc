import pytest

from tempora.functions.analysis import ENGLISH, entity, split, tokens
from tempora.functions.porter import stem

# Texts and the terms that the default analyzer must give.
GOLDEN = [
    ("AT&T getting secret immunity from wiretapping laws for government surveillance http://vrge.co/ZP3Fx5", "att get secret immun from wiretap law govern surveil http://vrge.co/ZP3Fx5"),
    ("want to see the @verge aston martin GT4 racer tear up long beach? http://theracersgroup.kinja.com/watch-an-aston-martin-vantage-gt4-tear-around-long-beac-479726219 …", "want see @verge aston martin gt4 racer tear up long beach http://theracersgroup.kinja.com/watch-an-aston-martin-vantage-gt4-tear-around-long-beac-479726219"),
    ("Incredibly good news! #Drupal users rally http://bit.ly/Z8ZoFe  to ensure blind accessibility contributor gets to @DrupalCon #Opensource", "incred good new #drupal user ralli http://bit.ly/Z8ZoFe ensur blind access contributor get @drupalcon #opensource"),
    ("We're entering the quiet hours at #amznhack. #Rindfleischetikettierungsüberwachungsaufgabenübertragungsgesetz", "were enter quiet hour #amznhack #rindfleischetikettierungsüberwachungsaufgabenübertragungsgesetz"),
    ("The 2013 Social Event Detection Task (SED) at #mediaeval2013, http://bit.ly/16nITsf  supported by @linkedtv @project_mmixer @socialsensor_ip", "2013 social event detect task sed #mediaeval2013 http://bit.ly/16nITsf support @linkedtv @project_mmixer @socialsensor_ip"),
    ("U.S.A. U.K. U.K USA UK #US #UK #U.S.A #U.K ...A.B.C...D..E..F..A.LONG WORD", "usa uk uk usa uk #us #uk #u sa #u k abc d e f long word"),
    ("this is @a_valid_mention and this_is_multiple_words", "@a_valid_mention multipl word"),
    ("PLEASE BE LOWER CASE WHEN YOU COME OUT THE OTHER SIDE - ALSO A @VALID_VALID-INVALID", "pleas lower case when you come out other side also @valid_valid invalid"),
    ("＠reply @with #crazy ~＃at", "＠reply @with #crazy ＃at"),
    (":@valid testing(valid)#hashtags. RT:@meniton (the last @mention is #valid and so is this:@valid), however this is@invalid", "@valid test valid #hashtags rt @meniton last @mention #valid so @valid howev invalid"),
    ("this][is[lots[(of)words+with-lots=of-strange!characters?$in-fact=it&has&Every&Single:one;of<them>in_here_B&N_test_test?test\\test^testing`testing{testing}testing…testing¬testing·testing what?", "lot word lot strang charact fact ha everi singl on them here bn test test test test test test test test test test test what"),
    ("@Porsche : 2014 is already here #zebracar #LM24 http://bit.ly/18RUczp  pic.twitter.com/cQ7z0c2hMg", "@porsche 2014 alreadi here #zebracar #lm24 http://bit.ly/18RUczp pic.twitter.com/cQ7z0c2hMg"),
    ("Some cars are in the river #NBC4NY http://t.co/WmK9Hc…", "some car river #nbc4ny http://t.co/WmK9Hc"),
    ("“@mention should be detected", "@mention should detect"),
    ("Mr. Rogers's shows", "mr roger show"),
    ("'Oz, The Great and Powerful' opens", "oz great power open"),
    ("Brother of Oscar Pistorius, Carl Pistorius appears in court over road deathhttps://gu.com/p/3em7p/tw ", "brother oscar pistoriu carl pistoriu appear court over road death https://gu.com/p/3em7p/tw"),
]


@pytest.mark.parametrize(("text", "expected"), GOLDEN)
def test_golden(text, expected):
    assert tokens(text) == expected.split()


def test_options():
    assert tokens("The Laws", frozenset(), stemming=False) == ["the", "laws"]
    assert tokens("The Laws", preserve_caps=True, stemming=False) == ["The", "Laws"]
    assert tokens("running laws", keep=frozenset({"running"})) == ["running", "law"]
    assert tokens(None) == tokens("") == tokens("…") == []
    assert "the" in ENGLISH and entity("#1") is None and entity("#a1") == "tag"
    assert split("a") == (("a", False),)


@pytest.mark.parametrize(("word", "root"), [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("electricity", "electr"), ("adjustment", "adjust"), ("controlling", "control"), ("probate", "probat"), ("rate", "rate"), ("by", "by")])
def test_stem(word, root):
    assert stem(word) == root


def test_analyzer_on_spark(spark):
    from tempora.engine import analyze

    got = {r.id: r.terms for r in analyze(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)] + [(99, None)], "id int, text string")).collect()}
    assert got[99] == [] and all(got[i] == e.split() for i, (_, e) in enumerate(GOLDEN))


def test_a_word_is_analyzed_once(monkeypatch):
    """However often a word comes, its terms are looked up whole; long words aren't kept, and what is kept is bounded."""
    from tempora.functions import analysis

    asked, split = [], analysis.split
    monkeypatch.setattr(analysis, "split", lambda *a: asked.append(a[0]) or split(*a))
    stop = frozenset({"the", "once"})
    for _ in range(50):
        assert analysis.tokens("The dogs, #Tag running. http://t.co/X dogs", stop) == ["dog", "#tag", "run", "http://t.co/X", "dog"]
    assert len(asked) == 6
    monkeypatch.setattr(analysis._Known, "MOST", 100)
    analysis.tokens(" ".join(f"w{i}" for i in range(1000)) + " " + "x" * 1000, stop)
    known = analysis._known(stop, True, False, frozenset())
    assert len(known) <= 100 and "x" * 1000 not in known
