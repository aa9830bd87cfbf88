"""Fixed word lists, by language. Portuguese is the working language; the small lists for the other languages serve
corpora written in them. All entries are in normalised form (lower case, no accents)."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: Portuguese -------------------------------------------------------------------------------------
STOP_PT = (
    "a ao aos as o os um uma uns umas de da do das dos dum duma em no na nos nas num numa por pelo pela pelos pelas "
    "para pra pro com sob sobre entre ate apos ante contra desde e ou mas que se como quando onde quem qual quais cujo "
    "cuja porque pois ja tambem so mais menos muito muita muitos muitas pouco tao tanto isso isto aquilo esse essa "
    "esses essas este esta estes estas aquele aquela aqueles aquelas ele ela eles elas eu tu voce voces vos lhe lhes me "
    "te seu sua seus suas meu minha nosso nossa dele dela deles delas foi ser sao era eram sera seria sido sendo estao "
    "estava estavam estar esteve tem tinha ter tido ha havia haver vai vao ia fazer faz fez feito diz disse dizem dizer "
    "afirma afirmou afirmam declarou falou segundo ai la aqui ali bem ainda sim entao todo toda todos todas outro outra "
    "outros outras mesmo mesma cada qualquer algum alguma alguns algumas nada tudo ninguem algo coisa verdade "
    "the of and to in on for is are was were be by with at from this that it an or"
).split()
# "no" is a preposition here, so it is not a negation.
NEG_PT = "nao nunca jamais nem nenhum nenhuma negou nega negam desmente desmentiu desmentem not never".split()
CONNECTORS_PT = ["de", "da", "do", "das", "dos", "del"]
GENERIC_PT = (
    "aconteceu acontece acontecer ocorreu ocorre noticia noticias informacao caso assunto polemica sabe saber alguem "
    "pessoa pessoas gente hoje ontem agora semana ano anos mes dia dias recentemente video post publicacao print foto "
    "mil milhao milhoes bilhao bilhoes reais dolares cento existe existem existir existia existiam pode podem poderia "
    "situacao situacoes alguma algum entenda veja saiba confira explicacao guia resumo detalhes volta voltam voltar "
    "bate batem bater fica ficam ficar passa passam passar chega chegam chegar segue seguem ganha ganham faz fazem deve "
    "devem novo nova novos novas meio pais paises"
).split()
MONTHS_PT = {
    "janeiro": 1, "fevereiro": 2, "marco": 3, "abril": 4, "maio": 5, "junho": 6, "julho": 7, "agosto": 8,
    "setembro": 9, "outubro": 10, "novembro": 11, "dezembro": 12,
}
WEEKDAYS_PT = {"domingo": "SUN", "segunda": "MON", "terca": "TUE", "quarta": "WED", "quinta": "THU", "sexta": "FRI",
               "sabado": "SAT"}
SUFFIXES_PT = (
    "amentos imentos amento imento acoes icoes acao icao mente aram eram iram ando endo indo ados idos adas idas ado "
    "ido ada ida ou am em ar er ir os as es s a o e"
).split()
NUMBER_WORDS_PT = {
    "dois": 2, "duas": 2, "tres": 3, "quatro": 4, "cinco": 5, "seis": 6, "sete": 7, "oito": 8, "nove": 9, "dez": 10,
    "onze": 11, "doze": 12, "treze": 13, "catorze": 14, "quatorze": 14, "quinze": 15, "dezesseis": 16,
    "dezessete": 17, "dezoito": 18, "dezenove": 19, "vinte": 20, "trinta": 30, "quarenta": 40, "cinquenta": 50,
    "sessenta": 60, "setenta": 70, "oitenta": 80, "noventa": 90, "cem": 100, "nenhum": 0, "nenhuma": 0,
}
ORDINALS_PT = {
    "primeiro": 1, "primeira": 1, "segundo": 2, "segunda": 2, "terceiro": 3, "terceira": 3, "quarto": 4, "quarta": 4,
    "quinto": 5, "quinta": 5, "sexto": 6, "sexta": 6, "setimo": 7, "setima": 7, "oitavo": 8, "oitava": 8, "nono": 9,
    "nona": 9, "decimo": 10, "decima": 10,
}
WEAK_NUMBERS_PT = {"um": 1, "uma": 1}
SCALES_PT = {"mil": 1e3, "milhao": 1e6, "milhoes": 1e6, "bilhao": 1e9, "bilhoes": 1e9, "trilhao": 1e12,
             "trilhoes": 1e12}
CHAMPION_PREFIXES_PT = {"bi": 2, "tri": 3, "tetra": 4, "penta": 5, "hexa": 6, "hepta": 7, "octa": 8, "enea": 9,
                        "deca": 10}
COMPARATORS_PT = [
    ("mais de", "min_excl"), ("acima de", "min_excl"), ("superior a", "min_excl"), ("pelo menos", "min"),
    ("ao menos", "min"), ("no minimo", "min"), ("menos de", "max_excl"), ("abaixo de", "max_excl"),
    ("inferior a", "max_excl"), ("no maximo", "max"), ("cerca de", "approx"), ("aproximadamente", "approx"),
    ("quase", "approx"), ("em torno de", "approx"), ("mais ou menos", "approx"),
]
QUALIFIER_STOP_PT = (
    "em segundo desde ate apos para por com que e ou entre durante contra sobre ao aos como segunda terca quarta quinta "
    "sexta sabado domingo janeiro fevereiro marco abril maio junho julho agosto setembro outubro novembro dezembro "
    "nesta neste nessa nesse hoje ontem agora atualmente feira conforme"
).split()
QUALIFIER_LINKS_PT = ["de", "da", "do", "das", "dos", "no", "na", "nos", "nas"]
GENERIC_UNITS_PT = ["%", "pessoas", "reais", "dolares", "euros", "anos", "vezes", "casos", "mortes", "mortos"]
TIME_UNITS_PT = "dia dias mes meses semana semanas hora horas minuto minutos ano anos".split()
# Ordered: the first stage whose words appear names the stage of the act.
STAGES_PT = [
    ("revogado", r"revoga|revogou|revogad\w*|derruba|derrubou|derrubad\w*|anula|anulou|anulad\w*|suspende|suspendeu|"
                 r"suspens\w*|barra|barrou|veta|vetou|vetad\w*"),
    ("negado", r"rejeita|rejeitou|rejeitad\w*|nega|negou|arquiva|arquivou|arquivad\w*"),
    ("vigente", r"entra em vigor|entrou em vigor|passa a valer|passou a valer|em vigor|sanciona|sancionou|sancionad\w*|"
                r"promulga|promulgou"),
    ("aprovado", r"aprova|aprovou|aprovad\w*"),
    ("proposto", r"propoe|propos|proposta|propostas|projeto de lei|pl|pretende|planeja|estuda|quer|deve votar|apresenta|"
                 r"apresentou|apresentad\w*|avalia|discute"),
    ("decidido", r"determina|determinou|proibe|proibiu|proibid\w*|decreta|decretou|decide|decidiu|edita|editou|assina|"
                 r"assinou|publica|publicou|obriga|obrigou"),
    ("previsto", r"preve|previu|previst\w*|vai|devera|deverao"),
]
ARTICLE_TYPE_WORDS_PT = (
    "lista listas titulos confrontos historia temporada temporadas resultados estatisticas elenco jogadores presidentes "
    "treinadores eleicoes eleicao controversias cronologia"
).split()
GENERIC_HEADS_PT = (
    "governo prefeitura camara secretaria ministerio tribunal justica federacao associacao entidade entidades clube "
    "clubes time times empresa empresas vereadores deputados senadores ministros ministro ministra presidente "
    "governador governadora prefeito prefeita policia estado municipio cidade orgao instituto conselho comissao "
    "sindicato partido grupo jogadores torcedores moradores autoridades especialistas agremiacao equipe equipes federal "
    "estadual municipal nacional brasileiro brasileira diretoria"
).split()
LIGHT_WORDS_PT = (
    "primeiro primeira segundo segunda ultimo ultima novo nova mais menos quer querem pode podem sera vai vao tambem "
    "apenas ainda sobre contra apos antes depois hoje ontem noite manha tarde entenda veja saiba diz afirma mostra "
    "mostram aponta apontam revela revelam indica indicam conforme acordo"
).split()
SUBORDINATORS_PT = "que apos depois antes enquanto quando caso sobre".split()
PASSIVE_BY_PT = "pelo pela pelos pelas".split()
AUXILIARIES_PT = "foi foram sera serao seria sao e era sendo ser sido".split()
COURT_WORDS_PT = "stf stj tse tst supremo justica tribunal corte acao pedido peticao recurso ingresso mandado".split()
DETERMINERS_PT = "o a os as um uma da do das dos de no na nos nas ao aos contra sobre com pela pelo sem em num numa".split()
DECISION_CLASSES = ["aprovar", "proibir", "impor", "revogar", "rejeitar", "decidir"]
PLAN_CLASSES = ["propor", "anunciar"]
OPPOSITE_CLASSES = ["alta", "queda"]
# Ordered: ties on position go to the longer match, then to the earlier entry.
COURT_PT = r"(?:stf|stj|tse|tst|stm|trf\d?|tj\w*|supremo|justica|tribunal|tribunais|corte|cortes|juiz|juiza|vara)"
ACTIONS_PT = [
    ("justica", r"acion\w+|recorr\w+|contest(?:a|am|ou|aram)|ajuiz\w+|protocol\w+|petici\w+|impetr\w+|"
                r"process(?:a|am|ou|aram|ara|ar)"),
    ("justica", r"(?:entr\w+|ingress\w+) com (?:uma |um |nova |novo |o |a )?(?:acao|acoes|pedido|pedidos|peticao|recurso|"
                r"mandado|representacao|queixa|habeas)"),
    ("justica", rf"ingress\w+ (?:em|na|no|numa|num|em uma) (?:\w+ ){{0,2}}(?:acao|processo|{COURT_PT})"),
    ("justica", r"(?:pede|pedem|pediu|pediram|pedido de) ingresso"),
    ("justica", rf"(?:vai|vao|foi|foram|ir|leva\w*|entr\w+|ingress\w+|recorre\w*) (?:ao|a|aos|na|no|junto ao) {COURT_PT}"),
    ("justica", rf"(?:pede|pedem|pediu|pediram|solicit\w+|requer\w*|cobr\w+) (?:ao|a|aos|junto ao) {COURT_PT}"),
    ("rejeitar", r"(?:nega|negam|negou|negaram|rejeit\w+|arquiv\w+|indefer\w+) (?:o |a |os |as )?(?:recurso|recursos|"
                 r"pedido|pedidos|habeas|liminar|acao|mandado|denuncia)"),
    ("confirmar", r"confirm\w+|nega|negam|negou|negaram|desment\w+"),
    ("prazo", r"(?:da|dao|deu|deram|estabelec\w+|fix\w+|defin\w+|concede\w*|concedeu) (?:um |o |novo )?(?:prazo|[0-9]+)"),
    ("aprovar", r"aprov\w+|sancion\w+|promulg\w+"),
    ("impor", r"impoe|impoem|impos|impuseram|impor|impora|institu(?:i|em|iu|iram)|tax(?:ou|aram|ara)|sobretax(?:ou|aram)"),
    ("impor", r"(?:aplic|cobr)(?:a|am|ou|aram|ara) (?:uma |nova |novas )?(?:taxa|tarifa|sobretaxa|aliquota|multa|sancao|sancoes)"),
    ("impor", r"(?:cria|criam|criou|criaram) (?:uma |nova |novas )?(?:taxa|tarifa|sobretaxa|cota|cotas|aliquota)"),
    ("organizar", r"organiz\w+|promov(?:e|em|eu|eram|ido|ida|idos|idas)|realiz(?:a|am|ou|aram|ado|ada|ados|adas)|"
                  r"oferec(?:e|em|eu|eram|ido|ida)"),
    ("proibir", r"proib\w+|proibe|bane|baniu|banir|ved(?:a|am|ou|ar)|restring\w+"),
    ("revogar", r"revog\w+|suspend\w+|suspens\w+|derrub\w+|anul\w+|cancel\w+|interromp\w+|cass(?:a|am|ou|aram)|"
                r"sust(?:a|am|ou|aram)|invalid\w+|revert(?:e|em|eu)"),
    ("rejeitar", r"rejeit\w+|arquiv\w+"),
    ("decidir", r"mand(?:a|am|ou|aram) (?:o |a |os |as |\w+ )?\w+(?:ar|er|ir)"),
    ("decidir", r"decid\w+|determin\w+|julg\w+|mantem|manteve|autoriz\w+|liber(?:a|am|ou|aram)|conden\w+|absolv\w+|"
                r"decret\w+|ordena\w*|acat(?:a|am|ou|aram)|defer(?:e|em|iu)|restabelec\w+|restaur(?:a|am|ou)|preve|preveem|previu|estabelec(?:e|em|eu)"),
    ("propor", r"propo\w+|propos\w*|sugere\w*|sugeriu|planej\w+|pretend\w+|articul\w+|prepar\w+|estud(?:a|am)|"
               r"projeto de lei|avali(?:a|am)"),
    ("anunciar", r"anunci\w+|lanc(?:a|am|ou|aram)|divulg\w+"),
    ("declarar", r"diz|dizem|disse|disseram|afirm\w+|declar\w+|defend\w+|critic\w+|coment\w+|posicion\w+|manifest\w+|"
                 r"rebat\w+|alert\w+|reag\w+|cobr(?:a|am|ou)|elogi\w+|atac\w+"),
    ("pedir", r"pede|pedem|pediu|pediram|solicit\w+|requer\w*|reivindic\w+"),
    ("investigar", r"investig\w+|apur\w+|denunci\w+|indici\w+|prend\w+|preso|presos|presa|operacao"),
    ("visitar", r"visit\w+|inaugur\w+|particip\w+"),
    ("visitar", r"(?:vai|vao|foi|foram) (?:a|ao) (?:final|festa|evento|jogo|posse|cerimonia)"),
    ("contratar", r"contrat\w+|assin\w+|renov\w+|patrocin\w+|fech\w+ acordo"),
    ("competir", r"venc\w+|derrot\w+|perd(?:e|em|eu|eram)|empat\w+|golei\w+|elimin\w+|classific\w+"),
    ("ocorrencia", r"transbord\w+|ating\w+|desab\w+|incendi\w+|alag\w+|explod\w+|colid\w+|morr\w+|mata|matou"),
    ("nomear", r"nome(?:a|ia|ou|iam)|nomead\w+|demit\w+|exoner\w+|renunci\w+|elege|elegem|elegeu|eleit(?:o|a|os|as)|"
               r"reeleit(?:o|a)|empossad\w+|assum(?:e|em|iu|iram)"),
    ("alta", r"sob(?:e|em)|subi\w*|subir|aument(?:a|am|ou|aram)|cresc(?:e|em|eu|eram)|avanc(?:a|am|ou|aram)|dispar(?:a|am|ou)|"
             r"dobr(?:a|am|ou)"),
    ("alta", r"(?:bate|batem|bateu|atinge|atingem|atingiu|renova|renovou) (?:novo |um novo |o |nova )?(?:recorde|maxima|pico)"),
    ("queda", r"cai|caem|caiu|recu(?:a|am|ou)|diminu(?:i|em|iu)|despenc\w+|reduz|reduzem|reduziu|encolh\w+"),
    ("queda", r"(?:atinge|atingiu|bate|bateu) (?:o |a |novo |nova )?(?:minima|piso)"),
]

# --- fixed values: other corpus languages ---------------------------------------------------------------------------
STOP_EN = ("the of and to in on for is are was were be by with at from this that it as an or a not have has but which you "
           "they his her its will would there their what all").split()
STOP_FR = "le la les un une de du des et a au aux en dans que qui pour par sur avec est ce il elle on ne pas".split()
STOP_DE = "der die das und ist in im zu den von mit auf fur des dem ein eine einen nicht sich als auch es an".split()
STOP_ES = "el la los las un una de del y a en que con por para se su lo como mas es al no".split()
NEG_EN = "not never no nor none without".split()
MONTHS_EN = {"january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8,
             "september": 9, "october": 10, "november": 11, "december": 12}
CONNECTORS_EN = ["of", "de", "la", "del", "von"]

# --- fixed values: outlets, agencies, domains --------------------------------------------------------------------------
OUTLET_WORDS = ["uol", "globo", "g1", "afp", "extra", "boatos", "e-farsas"]
FACT_CHECKERS = [
    ("aosfatos.org", "Aos Fatos"), ("lupa.news", "Agência Lupa"), ("lupa.uol.com.br", "Agência Lupa"),
    ("projetocomprova.com.br", "Projeto Comprova"), ("estadao.com.br/verifica", "Estadão Verifica"),
    ("g1.globo.com/fato-ou-fake", "Fato ou Fake (g1)"), ("boatos.org", "Boatos.org"), ("e-farsas.com", "E-Farsas"),
    ("checamos.afp.com", "AFP Checamos"), ("factcheck.afp.com", "AFP Fact Check"),
    ("reuters.com/fact-check", "Reuters Fact Check"), ("bbc.com/portuguese/articles/c", "BBC News Brasil Verifica"),
    ("uol.com.br/confere", "UOL Confere"),
]
SCIENCE_DOMAINS = ["scielo.org", "scielo.br", "nih.gov", "fiocruz.br", "nature.com", "science.org", "thelancet.com",
                   "nejm.org", "bmj.com", "cochrane.org", "arxiv.org"]
SOCIAL_DOMAINS = ["instagram.com", "facebook.com", "x.com", "twitter.com", "tiktok.com", "youtube.com", "threads.net",
                  "kwai.com"]
BRANDS = ["iphone", "ipad", "ipod", "ifood", "imac", "icloud", "itunes", "ebay", "ios", "esports"]
DOMAIN_NOISE = ["com", "br", "org", "net", "gov", "leg", "jus", "www"]


@dataclass(frozen=True)
class Lexicon:
    """The word lists one language needs."""

    lang: str
    stop: list[str]
    negations: list[str]
    connectors: list[str] = field(default_factory=list)
    generic: list[str] = field(default_factory=list)
    months: dict[str, int] = field(default_factory=dict)


PT = Lexicon("pt", STOP_PT, NEG_PT, CONNECTORS_PT, GENERIC_PT, MONTHS_PT)
# The corpora mix these languages, so their lists are joined into one.
EUROPEAN = Lexicon("en+fr+de+es", list(dict.fromkeys(STOP_EN + STOP_FR + STOP_DE + STOP_ES)), NEG_EN, CONNECTORS_EN,
                   [], MONTHS_EN)
