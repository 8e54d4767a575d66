"""Frame decoders for compressed transfer syntaxes."""
