"""Schemas of the tables that sources make and operators take."""

TEXTS = "text_id string, id_type string, source_type string, title string, plain string, xml string, pmid int"
MENTIONS = "mention_id long, text_id string, begin int, end int, name string, type string, source string, candidates array<string>"
IDENTIFIED = "mention_id long, text_id string, gene_id string, name string, begin int, end int, score float, taxon int"
GENES = "gene_id string, taxon int, symbol string, names array<string>"
GENE_ATTRIBUTES = "gene_id string, attr string, value string"
DICTIONARY = "name string, ids array<string>, taxon int"
GOLD = "text_id string, gene_id string, excerpts array<string>"
PREDICTED = "text_id string, gene_id string, excerpt string, score float"
CLOSURE = "parent int, child int, distance int"
LCA = "goid1 int, goid2 int, lcaid int, dist1 int, dist2 int, depthlca int"
POSITION_MODEL = "label string, position int, token string, freq long"
SPANS = "sent_id string, start int, end int"

#: Columns of the gene table with one gene a line; lists are separated by "; ", the last two by ";", "-" is missing.
GENE_TSV = (
    "id", "taxon", "symbol", "names", "chr_loc", "summary", "rifs", "pmids", "mass", "length", "mutation",
    "domain", "subcell", "tissue", "interact", "function", "disease", "go_codes", "keywords",
)
#: Attribute tables of a gene store: table name -> value column.
ATTRIBUTE_TABLES = {
    "GR_GOID": "GOID", "GR_ChrLocation": "location", "GR_GeneRIF": "generif", "GR_PubMedID": "PMID", "GR_Summary": "summary",
    "GR_ProteinDisease": "disease", "GR_ProteinDomain": "domain", "GR_ProteinFunction": "function", "GR_ProteinKeywords": "keyword",
    "GR_ProteinLength": "length", "GR_ProteinMass": "mass", "GR_ProteinMutation": "mutation", "GR_ProteinTissueSpecificity": "tissue",
    "GR_ProteinSubcellularLocation": "location", "GR_ProteinInteraction": "interaction", "GR_Names": "name", "GR_ProteinNames": "name",
    "GR_Origin": "taxon",
}
