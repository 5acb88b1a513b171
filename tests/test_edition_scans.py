"""Edition scans: text pieces, and nodes, scenes, pages, tokens and passages of small editions."""

import pytest

from quirework.sources import editions, markup


def scan(spark, **files):
    return markup.events(spark.createDataFrame([(p, x.encode()) for p, x in files.items()], "path string, content binary"))


def test_pieces_are_collapsed_composed_and_marked():
    assert editions.joined([("text", "  heaue"), ("text", "̄s \n"), ("text", " and  "), ("text", "")]) == ("heauēs and", [], [])
    parts = [("text", "a "), ("open", "italic"), ("text", "b"), ("close", "italic"), ("place", "p"), ("open", "italic"), ("text", "c "), ("close", "italic"), ("marked", None), ("open", "sup"), ("close", "sup"), ("close", "song"), ("open", "song"), ("text", "d ")]
    assert editions.joined(parts) == ("a bc •d", [(2, 5, "italic"), (5, 6, "gap"), (6, 7, "song")], [("p", 3)])
    assert editions.joined([("open", "song"), ("text", "  ")]) == ("", [], [])
    assert editions.joined([]) == ("", [], [])


EARLY = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body>
  <div type="play"><head>THE ROMANCE.</head></div>
  <div type="play"><pb n="1"/><head>THE TEMPEST.</head>
    <div n="1" type="act"><head>Actus primus,</head>
      <div n="1" type="scene"><head>Scena prima.</head>
        <stage>A tempeſtuous noiſe: En<g ref="char:EOLhyphen"/>ter a Ship-maſter.</stage>
        <sp><speaker>Maſter.</speaker><p><seg rend="decorInit">B</seg>Ote-ſwaine.</p></sp>
        <sp><speaker>Alon.</speaker>
          <p>Good Boteſwain<gap reason="illegible"><desc>•</desc></gap> haue care<g ref="char:punc">▪</g></p>
          <l>Since y<hi rend="sup">u</hi> doſt giue me <hi>Naples,</hi> heaue<g ref="char:cmbAbbrStroke">̄</g>s</l>
          <l><stage>Burthen.</stage>Harke, harke<stage>Exit.</stage> bowgh</l>
          <lg type="song"><head>Song.</head><l>Come vnto theſe <pb n="7"/>yellow ſands,</l></lg>
        </sp>
      </div>
    </div>
    <div n="3" type="act"><head>Actus Tertius.</head>
      <div n="1" type="act"><head>Scoena Prima.</head><pb n="2"/>
        <sp><speaker>Fer.</speaker><l>There be ſome Sports are painfull</l></sp>
      </div>
    </div>
    <div type="epilogue"><head>EPILOGVE.</head><l>NOw my Charmes</l><l>are all</l></div>
    <div type="dramatis_personae"><head>Names of the Actors.</head><p>Ariel</p></div>
  </div>
</body></text></TEI>"""
PARTLY = """<TEI><text><body><div type="play">
  <div type="prologue"><head>The Prologue.</head><l>In Troy there lyes the Scene</l></div>
  <div n="1" type="act"><head>THE TRAGEDIE OF HAMLET.</head><head type="sub">Actus Primus.</head>
    <div n="1" type="scene"><head>Scoena Prima.</head><sp><speaker>Bar.</speaker><p>Who's there?</p></sp></div></div>
  <div n="2" type="act"><head>Actus Secundus.</head>
    <stage>Enter Polonius, and Reynoldo.</stage><sp><speaker>Polon.</speaker><p>Giue him his money</p></sp>
    <div n="2" type="scene"><head>Scena Secunda.</head><sp><speaker>Pol.</speaker><floatingText type="letter"><body>
      <opener>To the Celestiall, and my Soules Idoll,</opener><q><l>Doubt thou, the Starres are fire,</l></q></body></floatingText></sp></div></div>
</div></body></text></TEI>"""
QUARTO = """<TEI><text><body><div type="text"><head>The history of Troylus and Cresseida.</head>
  <stage>Enter Hector and Troylus.</stage>
  <sp><speaker>Hect.</speaker><l>This I presume will wake him.</l><stage>Exeunt.</stage><p>How now Thersites?</p></sp>
  <sp><speaker>Hect.</speaker><l>Why then flie on.</l><stage>Exit.</stage><stage>Enter Achilles with Myrmidons.</stage><l>Come here about me,</l></sp>
  <sp><speaker>Rom.</speaker><l>Stay fellow, I can read.</l><q>SEigneur Martino, and his daugh<g ref="char:EOLhyphen"/>ters:</q></sp>
  <stage>He reads.</stage><floatingText type="letter"><body><p>A letter.</p></body></floatingText>
  <trailer>FINIS.</trailer></div></body></text></TEI>"""


@pytest.fixture(scope="module")
def early(spark):
    """Scenes and nodes of all early prints, read together."""
    play = editions.early_play(scan(spark, a=EARLY, b=PARTLY, c=QUARTO, d=QUARTO.replace("Hect.", "Hec.")), "TEMPEST|HAMLET|Troylus").cache()
    scenes = editions.early_scenes(play).cache()
    nodes = editions.early_nodes(play, scenes).orderBy("path", "idx").collect()
    rows = scenes.orderBy("path", "turn").collect()
    return lambda p: ([s for s in rows if s.path == p], [n for n in nodes if n.path == p])


def test_nodes_of_an_early_print(early):
    scenes, nodes = early("a")
    assert [(s.act, s.act_heading, s.key, s.heading) for s in scenes] == [(1, "Actus primus,", "1.1", "Scena prima."), (2, "Actus Tertius.", "2.1", "Scoena Prima."), (None, None, "epilogue", "EPILOGVE.")]
    got = [(n.scene, n.kind, n.text, n.form or n.sd_type, n.inline_at) for n in nodes]
    assert got == [
        (0, "sd", "A tempestuous noise: Enter a Ship-master.", None, None),
        (0, "line", "BOte-swaine.", "prose", None),
        (0, "line", "Good Boteswain• haue care•", "prose", None),
        (0, "line", "Since yu dost giue me Naples, heauēs", "verse", None),
        (0, "sd", "Burthen.", None, None),
        (0, "line", "Harke, harke bowgh", "verse", None),
        (0, "sd", "Exit.", None, 12),
        (0, "sd", "Song.", "label", None),
        (0, "line", "Come vnto these yellow sands,", "verse", None),
        (1, "line", "There be some Sports are painfull", "verse", None),
        (2, "line", "NOw my Charmes", "verse", None),
        (2, "line", "are all", "verse", None),
    ]
    marks = {n.idx: [tuple(m) for m in n.marks] for n in nodes if n.marks}
    assert marks == {2: [(14, 15, "gap"), (25, 26, "gap")], 3: [(7, 8, "sup"), (22, 29, "italic")], 8: [(0, 29, "song")]}
    assert {n.idx: [tuple(p) for p in n.pages] for n in nodes if n.pages} == {0: [("1", 0)], 8: [("7", 16)], 9: [("2", 0)]}
    assert [(n.speech, n.label) for n in nodes] == [(None, None), (0, "Master."), *[(1, "Alon.")] * 7, (2, "Fer."), (3, ""), (3, "")]


def test_divisions_and_letters(early):
    scenes, nodes = early("b")
    assert [(s.act, s.key, s.heading) for s in scenes] == [(None, "prologue", "The Prologue."), (1, "1.1", "Scoena Prima."), (2, "2.1", None), (2, "2.2", "Scena Secunda.")]
    assert [(n.scene, n.text) for n in nodes if n.scene > 1] == [(2, "Enter Polonius, and Reynoldo."), (2, "Giue him his money"), (3, "To the Celestiall, and my Soules Idoll,"), (3, "Doubt thou, the Starres are fire,")]


def test_speeches_end_where_everyone_leaves(early):
    scenes, nodes = early("c")
    assert [(s.key, s.editorial) for s in scenes] == [("1.1", True)]
    assert [(n.speech, n.label, n.text) for n in nodes] == [
        (None, None, "Enter Hector and Troylus."),
        (0, "Hect.", "This I presume will wake him."), (0, "Hect.", "Exeunt."), (1, "", "How now Thersites?"),
        (2, "Hect.", "Why then flie on."), (2, "Hect.", "Exit."), (None, None, "Enter Achilles with Myrmidons."), (3, "", "Come here about me,"),
        (4, "Rom.", "Stay fellow, I can read."), (4, "Rom.", "SEigneur Martino, and his daughters:"),
        (None, None, "He reads."), (5, "", "A letter."),
    ]
    assert [n.label for n in early("d")[1] if n.label] == ["Hec."] * 4 + ["Rom."] * 2


def test_lost_plays_are_told(spark):
    with pytest.raises(ValueError, match="no play matching"):
        editions.early_play(scan(spark, c=QUARTO), "MACBETH")
    with pytest.raises(ValueError, match="single play"):
        editions.early_play(scan(spark, a=EARLY))


W = lambda t, n="": f"<w{f' n=\"{n}\"' if n else ''}>{t}</w>"
C = "<c> </c>"
MODERN = f"""<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><interpGrp><interp xml:id="emend"> an editor's change </interp></interpGrp>
  <person xml:id="Prospero_Tmp"><persName><name>Prospero</name></persName></person><person xml:id="Miranda_Tmp"><persName><name>Miranda</name></persName></person>
  <listPerson><person xml:id="SPIRITS.Juno_Tmp" corresp="#SPIRITS_Tmp"/></listPerson></teiHeader><text><body>
  <div1 type="act" n="1"><head>{W("ACT")}</head><div2 type="scene" n="2"><head>{W("Scene")}</head>
    <stage xml:id="stg-0001" type="entrance">{W("Enter")}{C}{W("Prospero")}<lb/>{W("and")}{C}{W("Miranda")}<pc>.</pc></stage>
    <sp who="#Prospero_Tmp"><speaker>{W("PROSPERO")}</speaker><ab>
      <milestone unit="ftln" xml:id="ftln-0010" n="1.2.10" ana="#verse" next="#ftln-0011"/>
      <w xml:id="w1">Concluding</w>{C}<q><w xml:id="w2">Stay</w><pc xml:id="w3">.</pc></q>
      <stage xml:id="stg-0002" type="delivery">{W("To")}{C}<w xml:id="w9">Miranda</w><pc>.</pc></stage>
      {C}{W("Not")}{C}{W("yet")}
      <milestone edRef="#print #adobe" unit="ftln" xml:id="ftln-0010a" n="1.2.10" ana="#verse"/><app from="#w1"><rdg>old</rdg></app>
      <stage xml:id="stg-0003" type="delivery"><w></w></stage></ab></sp>
    <sp who="#Miranda_Tmp #Prospero_Tmp"><speaker>{W("MIRANDA")}</speaker><ab>
      <milestone unit="ftln" xml:id="ftln-0011" n="1.2.11" ana="#verse" prev="#ftln-0010"/>{W("Certainly")}<pc>,</pc>{C}{W("sir")}<pc>.</pc>
      <seg type="song"><milestone unit="ftln" xml:id="ftln-0012" n="1.2.12" ana="#verse"/>{W("Full")}{C}{W("fathom")}{C}{W("five")}
      <milestone unit="ftln" xml:id="ftln-0012b" ana="#verse"/>{W("thy")}</seg>
      <milestone unit="ftln" xml:id="ftln-0013" n="1.2.13" ana="#prose"/>{W("A")}{C}{W("<gap/>")}{C}{W('<hi rend="italic">as</hi>es')}</ab></sp></div2>
    <div2 type="chorus"><sp><ab><milestone unit="ftln" xml:id="ftln-0100" ana="#verse"/>{W("Now", "EPI.1")}</ab></sp></div2>
    <div2 type="act" n="3"><sp><ab><milestone unit="ftln" xml:id="ftln-0200" ana="#verse"/>{W("There")}</ab></sp></div2></div1>
  <div1 type="preface" n="preface"><ab>{W("Eternal")}</ab></div1>
  <ptr type="emendation" xml:id="ptr-1" ana="#emend" target="#w2 #w3 #w77"/><ptr type="other" xml:id="ptr-2" target="#w1"/></body></text></TEI>"""


def test_nodes_of_a_modern_edition(spark):
    nodes, tokens = editions.modern_nodes(scan(spark, m=MODERN))
    rows = nodes.orderBy("idx").collect()
    assert [(r.act, r.scene_kind, r.no, r.id, r.text, r.form or r.sd_type, r.part, r.n, r.inline_at) for r in rows] == [
        (1, "scene", 2, "stg-0001", "Enter Prospero and Miranda.", "entrance", None, None, None),
        (1, "scene", 2, "ftln-0010", "Concluding “Stay.” Not yet", "verse", "initial", "1.2.10", None),
        (1, "scene", 2, "stg-0002", "To Miranda.", "delivery", None, None, 18),
        (1, "scene", 2, "ftln-0011", "Certainly, sir.", "verse", "final", "1.2.11", None),
        (1, "scene", 2, "ftln-0012", "Full fathom five", "verse", None, "1.2.12", None),
        (1, "scene", 2, "ftln-0012b", "thy", "verse", None, None, None),
        (1, "scene", 2, "ftln-0013", "A • ases", "prose", None, "1.2.13", None),
        (1, "prologue", None, "ftln-0100", "Now", "verse", None, "EPI.1", None),
        (1, "scene", 3, "ftln-0200", "There", "verse", None, None, None),
    ]
    assert {r.id: [tuple(m) for m in r.marks] for r in rows if r.marks} == {"ftln-0012": [(0, 16, "song")], "ftln-0012b": [(0, 3, "song")], "ftln-0013": [(2, 3, "gap"), (4, 6, "italic")]}
    assert [(r.speakers, r.label) for r in rows[:4]] == [(None, None), *[(["prospero"], "PROSPERO")] * 2, (["miranda", "prospero"], "MIRANDA")]
    assert sorted((t.token, t.id, t.start, t.end) for t in tokens.collect()) == [("w1", "ftln-0010", 0, 10), ("w2", "ftln-0010", 12, 16), ("w3", "ftln-0010", 16, 17), ("w9", "stg-0002", 3, 10)]
    told = editions.passages(scan(spark, m=MODERN), tokens).orderBy("turn").collect()
    assert [tuple(r)[1:] for r in told] == [("ptr-1", "emend", "an editor's change", 0, "w2", "ftln-0010", 12, 16), ("ptr-1", "emend", "an editor's change", 1, "w3", "ftln-0010", 16, 17), ("ptr-1", "emend", "an editor's change", 2, "w77", None, None, None)]


def test_characters(spark):
    got = editions.characters(scan(spark, m=MODERN)).orderBy("turn").collect()
    assert [(r.id, r.name) for r in got] == [("prospero", "Prospero"), ("miranda", "Miranda"), ("spirits-juno", "Spirits Juno")]


def test_empty_scans(spark):
    none = scan(spark, m=MODERN).limit(0)
    nodes, tokens = editions.modern_nodes(none)
    assert nodes.collect() == tokens.collect() == editions.characters(none).collect() == []
    play = editions.early_play(none)
    assert editions.early_nodes(play, editions.early_scenes(play)).collect() == []
