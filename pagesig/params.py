"""Fixed values that must equal the original pipeline's for equal results.

They are parameters of the operators; these are the defaults.
"""

# --- fixed values -------------------------------------------------------------------------
PAGES_PER_OWNER = 7            # X: most recent observations on distinct hosts
MAX_SIGNATURES = 3             # AA: signatures per owner (groups allowed, spread bound)
SPREAD_LIMIT = 3               # BB: a line on more pages than this is a DX line
HISTORY_DAYS = 180             # observations kept relative to the newest one
SIZE_CLASS_BYTES = 1000        # L if octet length <= this, else H
MIN_ELEMENT_CHARS = 3          # shorter elements are dropped
VERDICT_THRESHOLD = 0.75       # found iff best score >= this
ELEMENT_KINDS = ["alerts", "texts", "images", "backgroundImages", "music"]
SIZE_CLASSES = ["L", "H"]
NO_AS_NUMBER = "3303"          # origin AS reported as empty
DNS_NO_RECORD = "No IPv4 nor IPv6 record"
DNS_NOT_IPV4 = "Not valid IPv4"
HIDDEN_PARENTS = ['style', 'script', '[document]', 'head']   # text inside is not visible
DOTTED_QUAD = r'^(\d{1,3}\.){0,3}\d{1,3}$'
CIDR = r'^(\d{1,3}\.){0,3}\d{1,3}/\d{1,2}$'
# --- end of fixed values ------------------------------------------------------------------

MAX_IP = 4294967295
MAX_PAGES = 63                 # pages per owner that induction can encode: bits of a long
