from . import files, records, registry
