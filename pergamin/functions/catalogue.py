"""Patterns, word lists and thresholds, in the dialect that Java and RE2 share wherever a meaning can be given in both.

Python's classes are written out: ``WORD`` for its word characters, ``SPACE`` for its white space. Case is that of Unicode: Java
needs ``(?iu)`` for it, RE2 ``(?i)``. A pattern pack (TOML) may override entries; see ``pergamin.sources.packs``.
"""

from __future__ import annotations

from dataclasses import dataclass

# White space and line boundaries as Python has them.
SPACE_SET = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACES = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SPACE = f"[{SPACE_SET}]"
SOLID = f"[^{SPACE_SET}]"
LINE_BREAK = r"\r\n|[\n\x{b}\x{c}\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
WORD = r"[\p{L}\p{N}_]+"
EDGE = r"(?:\A|\z|[^\p{L}\p{N}_])"  # the edge of a word, for tests; it takes a character
LATIN_WORD = "[A-Za-zÀ-ÿ]{2,}"

# Characters a document of the corpus prints; everything else is odd.
ODD_CHARACTER = r"[^a-zA-Z0-9áàâãéèêíìîóòôõúùûçÁÀÂÃÉÈÊÍÌÎÓÒÔÕÚÙÛÇ.,;:!?()\\/\"'`\-–—ºª°%\n\r\t ]"
USUAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789áàâãéèêíìîóòôõúùûçÁÀÂÃÉÈÊÍÌÎÓÒÔÕÚÙÛÇ.,;:!?()\\/\"'`-–—ºª°%\n\r\t "
CONTROL_CHARACTER = r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}-\x{9f}]"
GLYPH_INDEX = "(?:g[0-9]{1,4}){4,}+"  # possessive, so a long run is a loop and not a recursion

# Function words of the corpus language.
STOPWORDS = (
    "de da do das dos e a o os as em no na nos nas para por com que se ao aos à às um uma uns umas ou mas como quando onde este esta esse essa "
    "aquele aquela seu sua seus suas pelo pela pelos pelas nao não sim ser foi sao são tem ter entre sobre sem até após desde"
).split()

# Vocabulary expected of the domain, each between word boundaries.
DOMAIN = (
    "processo", "autos", "senten[cç]a", "ac[oó]rd[aã]o", "decis[aã]o", "despacho", "peti[cç][aã]o", "requerente", "requerido", "exequente",
    "executado", "impetrante", "impetrado", "tribunal", "vara", "juiz", "desembargador", "minist[eé]rio p[uú]blico",
)

# The conformity stamp that case-file systems print in the margin.
STAMP = (
    rf"(?:Este{SPACE}+documento{SPACE}+[ée]{SPACE}+(?:c[oó]pia{SPACE}+d[oe]{SPACE}+)?original.{{0,400}}?(?:c[oó]digo|chave)[^\n]{{0,80}})",
    rf"(?:Para{SPACE}+conferir{SPACE}+o{SPACE}+original.{{0,200}})",
    rf"(?:assinado{SPACE}+digitalmente{SPACE}+por[^\n]{{0,120}})",
    rf"(?:https?://{SOLID}*(?:pastadigital|docdigital|esaj){SOLID}*)",
    rf"(?:\bfls?\.{SPACE}*[0-9]+(?:{SPACE}*-{SPACE}*[0-9]+)?)",
    rf"(?:c[oó]digo{SPACE}+de{SPACE}+verifica[cç][ãa]o[^\n]{{0,60}})",
)
STAMP_LINE = (
    rf"(?:Este{SPACE}+documento{SPACE}+[ée]{SPACE}+c[oó]pia)|(?:assinado{SPACE}+digitalmente{SPACE}+por)|(?:Liberado{SPACE}+nos{SPACE}+autos{SPACE}+digitais)"
    rf"|(?:Para{SPACE}+(?:acessar|conferir){SPACE}+o?s?{SPACE}*(?:autos|original))|(?:c[oó]digo{SPACE}+de{SPACE}+verifica[cç][ãa]o)|(?:https?://{SOLID}*(?:pastadigital|docdigital|esaj))"
)

# What a model writes where it cannot read.
UNREAD = (
    rf"\[(?:IL+EG[IÍ]VEL|ILLEGIBLE|CARIMBO|STAMP|ASSINATURA|SIGNATURE|TRECHO{SPACE}+DANIFICADO|DAMAGED|SELO|SEAL|RUBRICA|IMAGEM|IMAGE|LOGO|BRAS[AÃ]O|VAZIO|EMPTY"
    rf"|EM{SPACE}+BRANCO|BLANK|N[AÃ]O{SPACE}+IDENTIFIC[\p{{L}}\p{{N}}_]*|UNIDENTIFIED|TEXTO{SPACE}+[^\]]*)[^\]]*\]"
)
ILLEGIBLE_MARKER, SIGNATURE_MARKER = "[ILEGÍVEL]", "[ASSINATURA]"

# Identifiers. A token is one if it has a letter, four digits and eight characters.
PUNCTUATED, DIGIT_RUN = "[0-9]{1,20}(?:[./-][0-9]{1,20}){2,}+", "[0-9]{5,}"

# Kinds of lines.
LEXICON_TOKEN = "[a-zà-ÿ]{3,}"
SHORT_WORDS = "de do da no na em os as ao um dos das nos nas pelo pela que com sem por para".split()
JUNK_CHARACTER = rf"[^\p{{L}}\p{{N}}_{SPACE_SET}.,;:!?()/%$°ºª\-]"
CAPS_TITLE = rf"\A[A-ZÀ-Þ0-9ºª.{SPACE_SET}/\-]+\z"
FOREIGN_SCRIPT = r"[\x{3000}-\x{303f}\x{3040}-\x{30ff}\x{3100}-\x{312f}\x{3130}-\x{318f}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}]"
REFERENCE_LINE = rf"\A[{SPACE_SET}0-9.\-/:ºªnN°ºfFlsLS$R,]+\z"
DATE_LINE = rf"(?iu)[0-9]{{1,2}}[/.\-{SPACE_SET}]+(?:de{SPACE}+)?[\p{{L}}\p{{N}}_]+[/.\-{SPACE_SET}]+(?:de{SPACE}+)?[0-9]{{2,4}}"
ANCHOR_LINE = rf"(?iu)@|https?://|www\.|e-?mail|endere[çc]o|{EDGE}(?:CEP|fone|tel|rua|av|pra[çc]a){EDGE}|[0-9]{{2,3}}\.[0-9]{{3}}-[0-9]{{3}}|\([0-9]{{2}}\){SPACE}?[0-9]"
JOB_TITLE = rf"(?iu)ju[íi1l]z|escriv|tabeli|procurad|promotor|of[íi1]cial|advogad|chefe{SPACE}+de{SPACE}+cart|diretor|delegad|anal[íi]sta|assessor|secret[áa]ri|defensor|perito|de{SPACE}+direito|de{SPACE}+justi[çc]a"
CAPS_NAME = rf"\A(?:(?:[A-ZÀ-Þ][a-zà-þ']+|[A-ZÀ-Þ]{{2,}}|d[aeo]s?|e)\.?{SPACE}+){{1,3}}(?:[A-ZÀ-Þ][a-zà-þ']+|[A-ZÀ-Þ]{{2,}}|d[aeo]s?|e)\.?\z"
STAMP_KEYWORDS = (
    rf"(?iu)selo{SPACE}+de{SPACE}+autentic|autenticidade|conf[ei]re{SPACE}+com|confer[êe]ncia|{EDGE}ICP[- ]?Brasil|verifica[çc][ãa]o|protocol|reconhe[çc]o|{EDGE}DJE?{EDGE}|tabeli(?:on|ão)"
    rf"|{EDGE}fé{SPACE}+p[úu]blic|junta{SPACE}+comercial|corregedor|minist[ée]rio{SPACE}+p[úu]blic|poder{SPACE}+judici|rep[úu]blica{SPACE}+federativa|tribunal|entregue|recebi(?:do)?{SPACE}+em|prenota[çc]"
)

# Marks of tables and seals.
AMOUNT_MARK = rf"(?iu)R\$|%|\bUFIR\b|\bR{SPACE}*\$"
RULE_MARK = rf"[.\-_·—]{{4,}}|[+|]{{2,}}|-{SPACE}-{SPACE}-|\|.*\|"
SEAL = (
    rf"(?iu)assinad[oa]{SPACE}+digitalmente|c[óo]digo{SPACE}+de{SPACE}+verifica[çc][ãa]o|liberado{SPACE}+nos{SPACE}+autos{SPACE}+digitais|conferir{SPACE}+o{SPACE}+original|docdigital|pastadigital|esaj"
)

# The printed background of identity cards and vehicle papers, upper case without accents.
TRAFFIC_OFFICE = r"\bDETRAN\b[ \-]{0,3}[A-Z]{2}\b"
IDENTITY_MARKS = (
    "VALIDA EM TODO O TERRITORIO NACIONAL", "LEI NO7 116 DE 29 08 83", "POLEGAR DIREITO", "ASSINATURA DO TITULAR", "ASSINATURA DO DIRETOR", "DATA DE EXPEDICAO",
    "DOC ORIGEM", "FILIACAO", "NATURALIDADE", "SECRETARIA DA SEGURANCA PUBLICA", "SECRETARIA DE ESTADO DA SEGURANCA PUBLICA",
    "INSTITUTO DE IDENTIFICACAO RICARDO GUMBLETON DAUNT", "INSTITUTO DE IDENTIFICACAO PEDRO MELLO", "INSTITUTO DE IDENTIFICACAO DO PARANA",
    "CADASTRO DE PESSOAS FISICAS", "CARTAO DE USO PESSOAL E INTRANSFERIVEL", "DEVE SER APRESENTADO JUNTO COM UM DOCUMENTO DE IDENTIDADE", "NUMERO DE INSCRICAO",
    "WWW CORREIOS COM BR", "MINISTERIO DAS CIDADES", "CARTEIRA NACIONAL DE HABILITACAO", "1A HABILITACAO", "CAT HAB", "ASSINATURA DO PORTADOR",
    "ASSINATURA DO EMISSOR", "DOC IDENTIDADE ORG EMISSOR UF", "PROIBIDO PLASTIFICAR", "DATA NASCIMENTO",
)
VEHICLE_MARKS = ("CERTIFICADO DE REGISTRO DE VEICULO", "CERTIFICADO DE REGISTRO E LICENCIAMENTO")
PERSONAL_LABEL = "documentos pessoais"

# Rules of running text.
ABBREVIATION = (
    r"(?iu)(?:(?U)\b(?:n|n[ºo]|art|arts|fls?|pág|p|inc|par|§|Sr|Sra|Srs|Dr|Dra|Drs|Exm[oa]|Ilm[oa]|Av|R|Rua|Al|Pça|Cia|Ltda|S\.?A|Jr|Proc|Cod|Cód|Est|Mun|Cap|Vol|Ed|Obs|Ref|Cf|Op|cit|etc|ap|apto|bl|qd|lt)\.\s*$)|(?:(?U)\b[A-ZÀ-Ö]\.\s*$)"
)
PAGE_NUMBER_ONLY = rf"(?iu)\A{SPACE}*(?:fls?\.?{SPACE}*[0-9]+|[0-9]{{1,3}}|p[áa]g(?:ina)?\.?{SPACE}*[0-9]+){SPACE}*\z"
ENCLITIC = r"(?iu)\A(?:l[oa]s?|lhes?|n[oa]s?|m[eo]|te|se|v[oo]s|[oa]s?)(?U)\b"
WRONG_CURRENCY = r"(?iu)(?<![A-Za-zÀ-ÿ0-9])(?:RS|R2|E\$|8\$|SR\$|3R\$|H\$|RE)\s*(?=[0-9]{1,3}(?:[.,][0-9]{3})*[.,][0-9]{2}(?![0-9]))"
ENGLISH_THOUSANDS = r"\b[0-9]{1,3}(?:,[0-9]{3})+[.,][0-9]{2}\b"
# A model's answer around its transcription, and marks of images in converted documents.
MD_FENCE = rf"\A{SPACE}*```[a-zA-Z]*{SPACE}*\n|\n{SPACE}*```{SPACE}*\z"
AFTER_THINK = rf"(?ius)\A.*?</think>{SPACE}*"
IMAGE_MARK = rf"(?iu)<!--{SPACE}*image{SPACE}*-->"
DELIMITED = rf"(?ius)==={SPACE}*INICIO DA TRANSCRICAO{SPACE}*==={SPACE}*(.*?)(?:==={SPACE}*FIM DA TRANSCRICAO{SPACE}*===|\z)"
LEADING_META = (
    rf"(?iu)\A{SPACE}*(?:(?:O{SPACE}+usu[áa]rio|A{SPACE}+imagem|Vou{SPACE}+|Segue{SPACE}+|Aqui{SPACE}+est[áa]|Estrutura{SPACE}+identificada|Elementos{SPACE}+identificados"
    rf"|Transcri[çc][ãa]o{SPACE}+(?:fiel|do|da)|The{SPACE}+user|The{SPACE}+image|Here{SPACE}+is)[^\n]*\n+)+"
)


# The limits of the gates.
@dataclass(frozen=True)
class Thresholds:
    """Every limit of the gates in one place, and which gates are on."""

    min_useful_words: int = 12
    min_chars_per_page: int = 200
    max_glyph_index: float = 0.10
    min_confidence: float = 70.0
    min_score: float = 0.35
    native_accept_score: float = 0.75
    min_agreement: float = 0.60
    min_reliable_words: int = 3
    min_text_page_chars: int = 100
    uncovered_image_share: float = 0.15
    max_marker_fraction: float = 0.80
    much_richer: float = 10.0
    max_targets: int = 10
    min_reread_gain: float = 0.08
    max_pages: int = 64
    max_witness_pages: int = 3
    agreement: bool = True
    consensus: bool = True
    vetoes: bool = True
    replacement: bool = True
    rebuild_prose: bool = True
