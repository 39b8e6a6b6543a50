"""Word lists, tables and formats that results depend on."""

# Fixed values, stated as they are.  Nothing here is logic.

#: Top-level domains taken as real.
TLDS = """
com org net edu gov mil int info biz name pro museum aero coop jobs travel mobi asia tel xxx post cat arpa top
xyz club online site shop app blog dev art web cloud page store host tech space live news io co me tv us uk ru
fr de jp cn au ca in it nl se no fi dk ch at be es pt br mx ar cl pe ve za pl cz gr hu ro ua by kz th sg my ph
vn id tr il ae sa ir pk eg ng kr tw hk mo eu nz ai gg im je
""".split()

#: Endings that are files, not domains.
FILE_EXTENSIONS = """
exe dll sys cmd bat ps1 vbs js pdf doc docx xls xlsx ppt pptx txt jpg jpeg png gif bmp zip rar 7z gz tar pif
scr msi jar py pyc pyo php asp aspx jsp htm html css json xml reg ini cfg log tmp dat db sqlite iso img vhd
vmdk
""".split()

#: Labels of programming constructs; compared with lower-case labels.
CODE_WORDS = """
document window console function addEventListener getElementById querySelector prototype constructor toString
valueOf typeof instanceof undefined gform jquery angular react vue
""".split()

#: Well-known domains.
LEGITIMATE_DOMAINS = """
github.com microsoft.com google.com facebook.com twitter.com linkedin.com youtube.com wikipedia.org amazon.com
apple.com stackoverflow.com adobe.com oracle.com mozilla.org apache.org wordpress.com cloudflare.com
akamai.com fastly.com debian.org ubuntu.com redhat.com centos.org python.org nodejs.org npmjs.com pypi.org
rubygems.org docker.com kubernetes.io microsoft.net live.com office.com outlook.com skype.com bing.com
yahoo.com yandex.ru baidu.com duckduckgo.com reddit.com instagram.com whatsapp.com telegram.org slack.com
zoom.us dropbox.com box.com salesforce.com atlassian.com jetbrains.com visualstudio.com eclipse.org
sourceforge.net gnu.org kernel.org w3.org ietf.org ieee.org cisco.com vmware.com ibm.com intel.com amd.com
nvidia.com dell.com hp.com lenovo.com asus.com kaspersky.com symantec.com mcafee.com trendmicro.com avast.com
bitdefender.com eset.com sophos.com paloaltonetworks.com fortinet.com fireeye.com crowdstrike.com
sentinelone.com carbonblack.com cylance.com virustotal.com hybrid-analysis.com malwarebytes.com spamhaus.org
sans.org mitre.org cve.mitre.org nvd.nist.gov us-cert.gov cert.org shodan.io censys.io zoomeye.org riskiq.com
domaintools.com alibabacloud.com aws.amazon.com azure.microsoft.com cloud.google.com digitalocean.com
godaddy.com namecheap.com squarespace.com wix.com habr.com medium.com dev.to hashnode.com blogger.com
""".split()

#: Well-known hosts, excluded by equality only.
LEGITIMATE_HOSTS = """
learn.microsoft.com docs.microsoft.com support.microsoft.com developer.mozilla.org wiki.debian.org
help.ubuntu.com access.redhat.com bugzilla.redhat.com git.kernel.org
""".split()

#: Words that keep a subdomain of a well-known domain.
SUSPICIOUS_LABELS = """
malware c2 payload evil bad attack exploit trojan virus worm botnet phishing scam backdoor rootkit keylogger
ransomware crypter
""".split()

#: File-sharing sites: URLs there are kept.
FILE_SHARING = """
pastebin.com paste.ee hastebin.com gist.github.com drive.google.com docs.google.com dropbox.com box.com
mediafire.com mega.nz wetransfer.com sendspace.com discord.com discord.gg telegram.me t.me transfer.sh file.io
anonfiles.com bayfiles.com
""".split()

#: Code hosts: URLs there are kept for suspicious paths only.
CODE_HOSTS = """
github.com gitlab.com bitbucket.org
""".split()

#: Words of suspicious paths on code hosts.
SUSPICIOUS_PATHS = """
malware exploit payload shellcode backdoor c2 c&c rat trojan ransomware crypter loader dropper injector
rootkit keylogger stealer miner botnet virus worm hack crack keygen poc cve- vulnerability pentest redteam
bypass mimikatz cobalt empire metasploit dsefix
""".split()

#: Documentation sites.
DOCUMENTATION = """
docs.microsoft.com learn.microsoft.com support.microsoft.com developer.apple.com support.apple.com
help.apple.com developers.google.com support.google.com cloud.google.com/docs docs.aws.amazon.com
docs.oracle.com docs.python.org developer.mozilla.org stackoverflow.com serverfault.com
""".split()

#: Words of a path that keep a documentation URL.
DOCUMENTATION_EXCEPTIONS = """
exploit vulnerability cve- poc bypass
""".split()

#: Substrings that disqualify a domain as a host.
HOST_STOPS = """
view via the and for with from document. window. console. function. gform. jquery. .addeventlistener
.prototype
""".split()

#: Machine names that are folders.
UNC_STOPS = """
users windows program
""".split()

#: Files of the operating system and browsers.
SYSTEM_FILES = """
svchost.exe explorer.exe winlogon.exe csrss.exe smss.exe lsass.exe services.exe spoolsv.exe taskhost.exe
dwm.exe userinit.exe logonui.exe wininit.exe kernel32.dll ntdll.dll user32.dll notepad.exe calc.exe cmd.exe
powershell.exe conhost.exe rundll32.exe regsvr32.exe chrome.exe firefox.exe iexplore.exe msiexec.exe
""".split()

#: Endings of a network location that is none.
ASSET_ENDINGS = """
.png .jpg .gif .css .js
""".split()

#: Phrases that show that a path is prose.
PATH_PHRASES = ["folder on the", "uploaded to", "artifacts were", "initially"]

#: Replacements of the refang chain, in order.
REFANG = [
    ("[.]", "."), ("(.)", "."), ("{.}", "."),
    ("[:]", ":"), ("(:)", ":"), ("{:}", ":"),
    ("[@]", "@"), ("[@ ]", "@"), ("(@)", "@"), ("{@}", "@"),
    ("[//]", "//"), ("{//}", "//"), ("[/]", "/"), ("{/}", "/"),
    ("hxxp://", "http://"), ("hxxps://", "https://"), ("hXXp://", "http://"), ("hXXps://", "https://"),
    ("h__p://", "http://"), ("h__ps://", "https://"),
]

#: Sequences that no real hash holds, and hex prefixes of file signatures.
HASH_RUNS = ["0123456789", "abcdef", "fedcba", "9876543210"]
HASH_SIGNATURES = ["4d5a", "504b", "377a", "89504e47", "ffd8ff"]

#: Order and titles of the text report's sections.
SECTIONS = [
    ("md5", "MD5 Hashes"), ("sha1", "SHA1 Hashes"), ("sha256", "SHA256 Hashes"), ("sha512", "SHA512 Hashes"),
    ("ssdeep", "SSDEEP Hashes"), ("imphash", "Import Hashes"), ("domains", "Domains"), ("hosts", "Hosts"),
    ("ips", "IP Addresses"), ("ipv6", "IPv6 Addresses"), ("urls", "URLs"), ("emails", "Email Addresses"),
    ("cves", "Vulnerabilities (CVEs)"), ("mitre_attack", "MITRE ATT&CK Techniques"), ("registry", "Windows Registry Keys"),
    ("mutex", "Mutex Names"), ("service_names", "Service Names"), ("named_pipes", "Named Pipes"), ("filenames", "Filenames"),
    ("filepaths", "Filepaths"), ("bitcoin", "Bitcoin Addresses"), ("ethereum", "Ethereum Addresses"),
    ("monero", "Monero Addresses"), ("mac_addresses", "MAC Addresses"), ("user_agents", "User Agents"), ("yara", "YARA Rules"),
    ("asn", "AS Numbers"), ("jwt", "JWT Tokens"), ("cert_serials", "Certificate Serial Numbers"),
]

#: STIX 2.1 patterns by indicator type; {value} is the escaped value.
STIX = {
    "domains": "[domain-name:value = '{value}']", "hosts": "[domain-name:value = '{value}']",
    "ips": "[ipv4-addr:value = '{value}']", "ipv6": "[ipv6-addr:value = '{value}']",
    "urls": "[url:value = '{value}']", "emails": "[email-addr:value = '{value}']",
    "md5": "[file:hashes.'MD5' = '{value}']", "sha1": "[file:hashes.'SHA-1' = '{value}']",
    "sha256": "[file:hashes.'SHA-256' = '{value}']", "sha512": "[file:hashes.'SHA-512' = '{value}']",
    "filenames": "[file:name = '{value}']", "filepaths": "[file:path = '{value}']", "cves": "[vulnerability:name = '{value}']",
}

#: File types by extension; others are text.
EXTENSION_TYPES = {".pdf": "pdf", ".html": "html", ".htm": "html", ".xml": "html", ".txt": "text", ".log": "text", ".md": "text", ".csv": "text", ".json": "text"}

#: Warning-list attributes (substrings) and the indicator types they make a list relevant for.
ATTRIBUTE_TYPES = {
    "domain": "domains", "hostname": "domains", "fqdn": "domains", "ip": "ips", "ipv4": "ips", "ipv6": "ipv6", "url": "urls",
    "uri": "urls", "email": "emails", "md5": "md5", "sha1": "sha1", "sha256": "sha256", "sha512": "sha512", "cve": "cves",
}

#: Attribute names that stand for an indicator type; {type} is the type itself.
ADDRESS_ATTRIBUTES = ["ip-src", "ip-dst", "ip-src|port", "ip-dst|port", "domain|ip", "ip", "ip-range", "ipv4", "ipv6"]
HASH_ATTRIBUTES = ["{type}", "filename|{type}", "hash", "attachment|{type}", "malware-sample|{type}"]
COIN_ATTRIBUTES = ["btc", "bitcoin", "cryptocurrency", "{type}", "crypto-address", "xmr", "eth"]
OTHER_ATTRIBUTES = ["{type}", "other", "text"]
TYPE_ATTRIBUTES = {
    **{t: ADDRESS_ATTRIBUTES for t in ("ips", "ipv6")},
    **{t: HASH_ATTRIBUTES for t in ("md5", "sha1", "sha256", "sha512", "ssdeep", "imphash")},
    **{t: COIN_ATTRIBUTES for t in ("bitcoin", "ethereum", "monero")},
    "domains": ["hostname", "domain", "domain|ip", "fqdn"],
    "urls": ["url", "uri", "link", "uri-path"],
    "emails": ["email", "email-src", "email-dst", "target-email", "email-address", "email-subject"],
    "cves": ["vulnerability", "cve", "weakness"],
    "mitre_attack": ["mitre-attack-pattern", "attack-pattern", "technique"],
}

#: Words in a list's name or description that make it worth a look for a type.
TYPE_KEYWORDS = {
    "ips": ["ip", "address", "ipv4", "ipv6", "cidr"], "domains": ["domain", "hostname", "fqdn", "dns"],
    "urls": ["url", "uri", "link"], "emails": ["email", "mail"], "cves": ["cve", "vulnerability"],
}
