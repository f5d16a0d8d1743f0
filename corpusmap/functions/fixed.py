"""Fixed values that results depend on."""

# Words never used as topic labels.
STOPWORDS = (
    "the and of to in for is on that by this with from "
    "as it are we an be was or which study analysis results "
    "using used paper based model data also were show can has "
    "effect effects different two method methods between these "
    "de la el en y a los se del las un por con no "
    "una su para es al lo como mas o pero sus le ya "
    "este esta estudio analisis resultados metodo desarrollo articulo "
    "mrow math xmlns inline msub mi mn mo msup msubsup "
    "msqrt mtext mathvariant bold display http www org 1998"
).split()

# Display names of record sources.
SOURCE_NAMES = {
    "openalex": "OpenAlex",
    "unam_repository": "Repositorio UNAM",
    "scielo_mexico": "SciELO México",
}

# Fixed value: source code given to every ingested record.
WORKS_SOURCE = "openalex"
