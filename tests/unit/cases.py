"""Cases of functions of texts: inputs, and what must come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritab.functions import cables, citations, dates, numbers, params, privacy, spans, templates, text, trees, words

CASES: dict[str, tuple] = {}


def by_case(name: str, inputs: str, outputs: dict[str, Callable[..., Column]], cases: list[tuple[tuple, tuple]], doc: str, before: dict[str, Callable[..., Column]] | None = None) -> None:
    CASES[name] = (inputs, outputs, cases, before or {})


def joined(items: Column, *fields: str) -> Column:
    said = lambda x: F.concat_ws(":", *[F.coalesce(x[f].cast("string"), F.lit("-")) for f in fields]) if fields else x
    return F.array_join(F.transform(items, said), "; ")


by_case(
    "cable_designations", "t string",
    {"found": lambda t: joined(cables.designations(t), "family", "geometry")},
    [
        (("Cabo XZ1(frt, zh) 5G10mm2 em tubo",), ("XZ1(frt,zh):5G10",)),
        (("RZ1-K (AS) 4x1x185mm² e H07V-U",), ("RZ1-K (AS):4x1x185; H07V-U:-",)),
        (("3x H07V-U 10mm²",), ("H07V-U:3x10",)),
        (("no século XV não havia cabo",), ("XV:-",)),
        (("o rei do século XV em Lisboa e na província da Estremadura",), ("",)),
        (("rvk 3 x 2.5",), ("RV-K:3x2,5",)),
        (("LXV 4(1x185) ao quadro",), ("LXV:4x1x185",)),
        (("H05VV‐F 3G1,5",), ("H05VV-F:3G1,5",)),
        ((None,), ("",)),
    ],
    "Designations in texts: family in one spelling and geometry; short families need a geometry or cables nearby.",
)

by_case(
    "cable_relations", "a string, b string",
    {"kind": lambda a, b: cables.kind(a), "flexible": lambda a, b: cables.flexible(a), "base": lambda a, b: cables.base(a), "may": lambda a, b: cables.may_be_equivalent(a, b)},
    [
        (("H07V-U", "H07V-K"), ("fio", False, "H07V", False)),
        (("H07V-U", "H07V-R"), ("fio", False, "H07V", True)),
        (("RV-K", "XZ1(frt,zh)"), ("cabo", True, "RV", True)),
        (("XZ1(frt,zh)", "XZ1(frt,zh)"), ("cabo", None, "XZ1", False)),
        (("H07RN-F", "XV-R"), ("cabo", True, "H07RN", False)),
        (("XV", "H07V-U"), ("cabo", None, "XV", False)),
    ],
    "Wire or cable, rigid or flexible, and which names may be proposed as equivalent.",
)

by_case(
    "parameter_readings", "t string",
    {"found": lambda t: joined(params.read(t), "name", "value", "unit")},
    [
        (("Luminária IP65 IK08, 36 W, 4.500 lm, 4000 K",), ("ip_rating:IP65:; ik_rating:IK08:; power_w:36:W; luminous_flux_lm:4.5:lm; color_temperature_k:4000:K",)),
        (("Icc 25 kA e tensão 230 V AC",), ("icc_ka:25:kA; voltage_v:230:V",)),
        (("Deteção com 14 m, 360º",), ("detection_range_m:14:m; detection_angle_deg:360:º",)),
        (("Autonomia: uma hora. Classe cca",), ("autonomy_h:1:h; cpr_class:Cca:",)),
        (("Módulo 550 Wp, eficiência de 21,3 %, 2279 x 1134 × 35 mm",), ("peak_power_wp:550:Wp; efficiency_pct:21.3:%; dimensions_mm:2279x1134x35:mm",)),
        (("produto 1812WP",), ("",)),
        ((None,), ("",)),
    ],
    "Typed parameters of a text by place.",
)

by_case(
    "parameter_inputs", "t string",
    {"ip": lambda t: params.normalize("ip_rating", t), "power": lambda t: params.shown("power_w", params.normalize("power_w", t))},
    [(("IP 65",), ("IP65", None)), (("54",), ("IP54", "54 W")), (("12,50",), ("IP12", "12,5 W")), (("uma",), (None, "1 W")), (("x",), (None, None)), ((None,), (None, None))],
    "What a person writes, read as the patterns read it, and shown with its unit.",
)

by_case(
    "class_requirements", "op string, required string, offered string",
    {"ok": lambda op, r, o: params.satisfies(op, r, o)},
    [
        ((">=class", "IP55", "IP65"), (True,)), ((">=class", "IP55", "IP44"), (False,)), ((">=class", "IPX4", "IP44"), (True,)), ((">=class", "IPX4", "IP54"), (True,)),
        ((">=class", "IP54", "IPX4"), (None,)), ((">=class", "IP65", "IPX4"), (None,)), ((">=class", "IK08", "IK10"), (True,)), ((">=class", "IK08", "IK07"), (False,)),
        ((">=class", "Cca", "B2ca"), (True,)), ((">=class", "Cca", "Eca"), (False,)), ((">=class", "Cca", "Zca"), (None,)), ((">=", "25", "36"), (True,)), (("<=", "25", "36"), (False,)),
        (("=", "4000", "4000.0"), (True,)), (("=", "4000", "3000"), (False,)), ((">=", "25", None), (None,)), (("info", "1", "1"), (None,)), ((">=", "x", "1"), (None,)),
    ],
    "Requirements against offers, three-valued: codes digit by digit, classes by rank, numbers.",
)

by_case(
    "numeral_words", "t string",
    {"n": lambda t: words.words_to_int(t)},
    [(("seis",), (6,)), (("dezasseis",), (16,)), (("dezesseis",), (16,)), (("vinte e dois",), (22,)), (("cento e vinte",), (120,)), (("quatorze",), (14,)), (("zero",), (0,)),
     (("trezentas e dezanove",), (319,)), (("duzentas",), (200,)), (("14",), (14,)), (("muitos",), (None,)), (("vinte e muitos",), (None,)), ((None,), (None,))],
    "Numbers in words.",
)

by_case(
    "counted_things", "t string",
    {"n": lambda t: words.quantity_of(t, "carregador", "pedestal")},
    [(("tres pedestals com dois carregadors em cada",), (6,)), (("instalar dezassete carregadors",), (17,)), (("quatro carregadors, dos quais dois carregadors ligados",), (4,)),
     (("dos quais dois carregadors",), (None,)), (("12 carregadors",), (12,)), (("sem nada",), (None,))],
    "How many things a text counts.",
)

CORPUS = [("DL96", r"(?i)decreto\W*lei\W*n\.?.?\s*96/2017"), ("EN60529", r"(?i)en 60 ?529"), ("RTIEBT", r"(?i)rtiebt")]
by_case(
    "cited_documents", "t string",
    {
        "found": lambda t: joined(citations.citations(t), "start", "text"),
        "codes": lambda t: F.array_join(F.transform(citations.citations(t), lambda c: F.coalesce(citations.first_code(c["text"], CORPUS), F.lit("?"))), ","),
        "incomplete": lambda t: F.size(citations.incomplete(t)),
    },
    [
        (("Decreto-Lei n.º 96/2017 e NP EN 60 529",), ("0:Decreto-Lei n.º 96/2017; 26:NP EN 60 529", "DL96,EN60529", 0)),
        (("segundo a secção das RTIEBT",), ("21:RTIEBT", "RTIEBT", 1)),
        (("Portaria n.º 949-A/2006, IEC 60364-4",), ("0:Portaria n.º 949-A/2006; 25:IEC 60364-4", "?,?", 0)),
        (("artigo 12 das RTIEBT",), ("14:RTIEBT", "RTIEBT", 0)),
        (("nada",), ("", "", 0)),
        ((None,), ("", "", 0)),
    ],
    "Citations by place, their entries of the corpus, and references without a number.",
)

by_case(
    "stray_number_snippets", "t string",
    {"found": lambda t: joined(citations.stray_numbers(t, 8))},
    [
        (("A potência é de 34 kVA no total",), ("ia é de 34 kVA no",)),
        (("Vale {{v:ele.p2}} com IP65 e 230/400 V",), ("",)),
        (("Decreto-Lei n.º 96/2017, secção 801.5 e art. 20",), ("",)),
        (("usar 3 ou 12,5",), ("usar 3 ou 12,5; ar 3 ou 12,5",)),
        (("nif 123456789 fim",), ("nif ••• fim",)),
        (("",), ("",)),
    ],
    "Numbers outside placeholders and allowed forms, with what stands around them, masked.",
)

by_case(
    "project_personal_data", "t string",
    {"kinds": lambda t: joined(privacy.personal(t), "kind"), "masked": lambda t: privacy.masked(t)},
    [
        (("mail ana@x.pt, nif 123456789",), ("email; nif", "mail •••, nif •••")),
        (("tel. 912 345 678 ou +351 212345678",), ("phone; phone; nif", "tel. ••• ou •••")),
        (("Rua da Prata 12, 1100-420 Lisboa",), ("address; postal_code", "••• 12, ••• Lisboa")),
        (("em março de 2021 ou 12/03/2021",), ("date; date", "em ••• ou •••")),
        (("OET n.º 12345; código de verificação: a1b2c3d4",), ("dgeg_oet; verification_code", "•••; •••")),
        (("CC 12345678 9 ZZ1",), ("cc", "••• 9 ZZ1")),
        (("valor 0,123456789",), ("", "valor 0,123456789")),
        ((None,), ("", None)),
    ],
    "The nine kinds of personal data of project texts, found and masked from left to right.",
)

by_case(
    "known_values_masked", "t string, v array<string>",
    {"masked": lambda t, v: privacy.masked_known(t, v)},
    [
        (("A Ana Maria Silva e a ana  maria", ["Ana Maria", "Ana Maria Silva", "A"]), ("A ••• e a •••",)),
        (("Anabela e Ana", ["Ana"]), ("Anabela e •••",)),
        (("mail ana@x.pt", []), ("mail •••",)),
        (("custo (a+b) x", ["(a+b)"]), ("custo ••• x",)),
        (("nada", [None, "xy"]), ("nada",)),
        ((None, ["Ana"]), (None,)),
    ],
    "Known values first, the longest first, then the patterns.",
)

by_case(
    "guarded_requests", "t string",
    {"kinds": lambda t: F.array_join(privacy.guard_findings(t, F.col("folded"), F.array(F.struct(F.lit("blocked_name").alias("kind"), F.lit("joao silva").alias("value")), F.struct(F.lit("personal_value").alias("kind"), F.lit("abc").alias("value")))), ",")},
    [(("Carta a João  Silva",), ("blocked_name",)), (("ana@x.pt e joao silva",), ("blocked_name,email",)), (("{{v:tec.nif123456789}} abc",), ("",)), (("Joaosilva",), ("",)), (("nif 123456789",), ("nif",))],
    "Kinds of personal data in a request: patterns without placeholders, and terms on the folded text.",
    {"folded": lambda t: text.fold(t)},
)

by_case(
    "pseudonym_styles", "k string, real string, n int",
    {"said": lambda k, r, n: privacy.pseudonym(k, r, n)},
    [
        (("nif", "123 456 789", 1), ("999 990 013",)), (("phone", "+351 912 345 678", 7), ("+351 900 000 007",)), (("email", "a@b.pt", 12), ("pessoa012@example.com",)),
        (("postal_code", "1100-420", 3), ("0000-003",)), (("address", "RUA DA PRATA", 4), ("RUA EXEMPLO 4",)), (("other", "x", 5), ("[DADO 5]",)),
    ],
    "Pseudonyms in reserved formats, in the style of the real value.",
)

by_case(
    "byte_hits", "b binary, v string",
    {"hit": lambda b, v: privacy.in_bytes(b, v)},
    [((b"\x00\x01Ana\x02", "Ana"), (True,)), (("Ana".encode("utf-16-le"), "Ana"), (True,)), ((b"\x07" + "xAna".encode("utf-16-le"), "Ana"), (True,)), ((b"An\x00a", "Ana"), (False,)), ((b"", "Ana"), (False,))],
    "Known values in the 8-bit and 16-bit decodings of raw bytes, at even and odd offsets.",
)

by_case(
    "issue_dates", "t string",
    {"issued": lambda t: dates.issue_date(text.fold(t)).cast("string")},
    [
        (("Rev. 2021-03",), ("2021-03-01",)), (("DATA / DATE: 2020.01.03",), ("2020-01-03",)), (("Edição: março de 2019",), ("2019-03-01",)), (("issued 45/13/2020, date 15/03/2021",), ("2021-03-15",)),
        (("updated: Sep 2022",), ("2022-09-01",)), (("2021-03-15",), (None,)), (("versão 03/2021",), ("2021-03-01",)), ((None,), (None,)),
    ],
    "The first valid date after a dating word; invalid dates are passed over.",
)

by_case(
    "board_names", "a string, b string",
    {"core": lambda a, b: text.core(a), "same": lambda a, b: text.same_board(a, b), "score": lambda a, b: text.match_score(text.core(a), text.core(b))},
    [(("Q.P.ATRIO", "ATRIO"), ("ATRIO", True, 2)), (("Q.E.", "QGBT"), ("QEG", True, 2)), (("Quadro Q.P.BIB.INF", "QP.BIB.INFANT."), ("BIBINF", False, 1)), (("Armario", "CP"), ("PORTINHOLA", True, 2)), (("Q", "X"), ("Q", False, 0)), (("Q.1", ""), ("1", False, 0))],
    "Names of boards by their cores; the supply entry and the main board have one name each.",
)

by_case(
    "revision_labels", "a string",
    {"following": lambda a: text.next_label(a)},
    [(("A",), ("B",)), (("Y",), ("Z",)), (("Z",), ("ZA",)), (("ZA",), ("B",))],
    "The label after another, as the last letter tells.",
)

by_case(
    "shorter_forms", "a string, b string",
    {"same": lambda a, b: text.same_words(a, b)},
    [(("mberal", "moradia unifamiliar mberal"), (True,)), (("ana silva", "ana maria da silva"), (True,)), (("rua da prata", "rua do ouro"), (False,)), (("ana", "ana maria"), (False,)), (("de", "de"), (True,)), (("", "moradia"), (False,))],
    "Equal words, or all words of the shorter form in the longer one if one of them is long enough.",
)

by_case(
    "comparable_forms", "k string, a string, b string",
    {"same": lambda k, a, b: text.comparable(k, a) == text.comparable(k, b)},
    [(("number", "1.234,5", "1234,50"), (True,)), (("number", "12", "13"), (False,)), (("board", "Q.P.ATRIO", "Atrio"), (True,)), (("entity", "A Câmara Municipal de Évora", "Município de Evora"), (True,)),
     (("phase", "Trifásica", "tri"), (True,)), (("phase", "Monofásica", "tri"), (False,)), (("text", "  São  João", "sao joao"), (True,)), (("number", "n/a", "N/A"), (True,))],
    "Values of two sources in the form in which they are compared, by kind of key.",
)

by_case(
    "further_number_grammars", "t string",
    {"said": lambda t: numbers.said_number(t), "grouped": lambda t: numbers.grouped_number(t)},
    [(("uma",), (1.0, None)), (("1.234",), (1.234, 1234.0)), (("1.234,5",), (None, 1234.5)), (("12,5",), (12.5, 12.5)), (("12.5",), (12.5, None)), (("1 234 567",), (None, 1234567.0)), (("x",), (None, None))],
    "The fourth and fifth number grammars; they differ on purpose.",
)

by_case(
    "shown_measures", "s double, p double",
    {"time": lambda s, p: numbers.minutes(s), "share": lambda s, p: numbers.percent(p)},
    [((90.0, 0.125), ("2 min", "12 %")), ((5399.0, 1.0), ("90 min", "100 %")), ((5400.0, 0.0), ("1.5 h", "0 %")), ((None, None), ("—", "—"))],
    "Times and shares as people read them.",
)

by_case(
    "work_steps", "screen string, hint string, reviewed boolean",
    {"step": lambda s, h, r: text.work_step(s, h, r)},
    [(("ficheiros", None, False), ("dados",)), (("documentos", "cte", False), ("cte",)), (("documentos", "x", False), ("mdj",)), (("documentos", "mdj", True), ("correcoes",)), (("validacao", None, True), ("verificacao",)), (("outro", "mdj", False), (None,))],
    "The step of work that a screen belongs to.",
)

by_case(
    "luminaire_codes", "t string",
    {"codes": lambda t: F.array_join(text.luminaire_codes(t), ","), "types": lambda t: F.array_join(F.array_distinct(F.transform(text.luminaire_codes(t), text.luminaire_type)), ",")},
    [(("Tipo L5.1, l5.2 e SNC",), ("L5.1,L5.2,SNC", "L5,SNC")), (("L10 e L2",), ("L10,L2", "L10,L2")), (("nada",), ("", ""))],
    "Codes of luminaires and the types they belong to.",
)

by_case(
    "tree_texts", "j string",
    {"plain": lambda j: trees.plain_text(j), "blocks": lambda j: F.array_join(trees.blocks(j), " | ")},
    [
        (('{"type":"doc","content":[{"type":"paragraph","content":[{"type":"text","text":"a "},{"type":"text","text":"b"}]},{"type":"paragraph"}]}',), ("a b", "a b | ")),
        (('{"type":"doc","content":[{"type":"locked","content":[{"type":"paragraph","content":[{"type":"text","text":"x"}]},{"type":"paragraph","content":[{"type":"text","text":"y"}]}]},{"type":"pending"}]}',), ("xy", "x | y")),
        (("{}",), ("", "")),
        (("not json",), (None, None)),
    ],
    "The text of a tree of nodes, and its paragraphs one by one; pending nodes stay out.",
)

by_case(
    "excerpts", "t string, a int, b int",
    {"said": lambda t, a, b: spans.snippet(t, a, b, 4)},
    [(("0123456789abcdef", 6, 8), ("…23456789ab…",)), (("short", 0, 2), ("short",)), (("a  b   c d e f", 3, 4), ("a b c…",)), ((None, 0, 1), (None,))],
    "What stands around a place, with an ellipsis where the text goes on.",
)

by_case(
    "folds_in_place", "t string",
    {"folded": lambda t: text.fold_in_place(t), "size": lambda t: F.length(text.fold_in_place(t)) == F.length(t)},
    [(("Ação ÉÀ",), ("acao ea", True)), (("ﬁm ½",), ("fm 1", True)), (("ABC",), ("abc", True)), ((None,), (None, None))],
    "A fold that keeps the places of the characters.",
)

by_case(
    "same_values", "a string, b string",
    {"same": lambda a, b: numbers.same(a, b, text.folded_text(a), text.folded_text(b))},
    [(("12,50", "12.5"), (True,)), (("1.234", "1234"), (True,)), (("Évora.", "evora"), (True,)), (("12", "13"), (False,)), (("a", "b"), (False,))],
    "Two values as numbers where both are, else as folded texts.",
)

by_case(
    "block_categories", "k string",
    {"category": lambda k: text.first_keyword(k, [("iluminacao", "lighting"), ("quadro", "boards"), ("fotovolt", "pv")])},
    [(("ele.quadros_iluminacao",), ("lighting",)), (("ele.quadros",), ("boards",)), (("ele.sistema_fotovoltaico",), ("pv",)), (("ele.terra",), (None,))],
    "The category of the first keyword that a key holds.",
)


by_case(
    "entry_differences", "t string, o string",
    {
        "fits": lambda t, o: templates.captured(t, o).isNotNull(),
        "differ": lambda t, o: joined(F.coalesce(templates.differing(t, o, F.col("values")), F.array().cast("array<struct<key:string,got:string,mine:string>>")), "key", "got", "mine"),
        "classes": lambda t, o: F.array_join(F.transform(F.coalesce(templates.differing(t, o, F.col("values")), F.array().cast("array<struct<key:string,got:string,mine:string>>")), lambda d: templates.difference_class(d["key"], d["got"], d["mine"])), ","),
    },
    [
        (("Potência de {{v:ele.p}} kVA em {{v:doc.local}}.", "Potência de 34,50 kVA em Lisboa."), (True, "ele.p:34,50:34.5; doc.local:Lisboa:-", "number_format,profile")),
        (("Requerente: {{v:req.nome}}", "Requerente:  ANA  SILVA"), (True, "req.nome:ANA SILVA:Ana Silva", "case")),
        (("Quadro {{v:ele.q}} e {{v:ele.p}}", "Quadro QP.2 e 34.5"), (True, "ele.q:QP.2:QP.1", "value")),
        (("Igual {{v:ele.q}}", "Igual QP.1"), (True, "", "")),
        (("Falta {{v:x.y}}", "Falta algo"), (True, "x.y:algo:-", "missing")),
        (("Um texto {{v:ele.q}}", "Outro texto QP.1"), (False, "", "")),
        (("Data {{v:doc.data}} (a+b)", "Data maio (a+b)"), (True, "doc.data:maio:-", "date")),
    ],
    "Texts against their templates: values captured, those that differ, and why.",
    {"values": lambda t, o: F.create_map(*[F.lit(x) for x in ("ele.p", "34.5", "req.nome", "Ana Silva", "ele.q", "QP.1")])},
)

by_case(
    "labelled_facts", "t string",
    {"found": lambda t: joined(templates.labelled(t, {"req.nome": "requerente|dono da obra", "doc.local": "local"}), "key", "value"), "brand": lambda t: templates.first_brand(t, ["Legrand", "ABB", "Hager"])},
    [
        (("Requerente: Ana Silva\nLocal - Lisboa\nLocal: x",), ("req.nome:Ana Silva; doc.local:Lisboa", None)),
        (("DONO DA OBRA: Município\nquadro ABB, série Hager",), ("req.nome:Município", "ABB")),
        (("tomada hager ou legrand",), ("", "Hager")),
        ((None,), ("", None)),
    ],
    "Labelled values of a text, and the brand that stands first in it.",
)

by_case(
    "expected_cases", "m string, w array<string>, r string, e string",
    {"found": lambda m, w, r, e: templates.case_found(m, w, r, e)},
    [(("Designação de cabos diferente: MDJ indica H07V-U", ["cabos", "h07v-u"], "A peça está errada.", "A peça"), (True,)), (("Potência diferente", ["cabos"], "A peça", "A peça"), (False,)), (("Potência diferente", ["potência"], "Vários", "A peça"), (False,)), (("x", [], "", ""), (True,))],
    "Whether an expected case is among the messages, with the reading expected.",
)
