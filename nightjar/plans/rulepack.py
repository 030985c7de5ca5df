"""Shipped detection rules: our own predicates and wording over public ATT&CK knowledge.

Identifiers, kinds, windows, counts, cooldowns, scores, confidences, phases and techniques are fixed values of
the rule set; so are the closed lists below.
"""

from __future__ import annotations

import re

from nightjar.operators.rules import RuleSpec

# --- fixed values: closed lists -----------------------------------------------------------------
OFFICE = ["winword.exe", "excel.exe", "outlook.exe", "powerpnt.exe"]
POWERSHELL = ["powershell.exe", "pwsh.exe"]
SCRIPT_HOSTS = ["cmd.exe", "powershell.exe", "pwsh.exe", "wscript.exe", "cscript.exe", "mshta.exe"]
INJECTORS = ["powershell.exe", "pwsh.exe", "rundll32.exe", "regsvr32.exe", "mshta.exe", "wscript.exe", "cscript.exe",
             "cmd.exe", "wmic.exe", "msbuild.exe", "installutil.exe"]
OFFICE_CHILDREN = ["cmd.exe", "powershell.exe", "pwsh.exe", "wscript.exe", "cscript.exe", "mshta.exe", "rundll32.exe",
                   "regsvr32.exe", "certutil.exe", "bitsadmin.exe"]
CONNECTING_HOSTS = ["powershell.exe", "pwsh.exe", "wscript.exe", "cscript.exe", "mshta.exe", "rundll32.exe",
                    "regsvr32.exe", "certutil.exe", "msbuild.exe"]
URL_LOADERS = ["mshta.exe", "regsvr32.exe", "rundll32.exe", "certutil.exe", "bitsadmin.exe", "wmic.exe"]
APPROVED_COUNTRIES = ["IN", "US", "GB", "DE", "SG", "CA", "AU", "NL", "FR", "JP"]
CONTROL_PORTS = [4444, 1337, 6666, 6667, 8081, 9001, 50050, 31337, 5555, 2222]
SANCTIONED = ["onedrive.live.com", "sharepoint.com", "office365.com", "microsoftonline.com", "googleapis.com",
              "drive.google.com", "docs.google.com", "dropbox.com", "box.com", "amazonaws.com", "blob.core.windows.net",
              "icloud.com", "apple.com"]
SANCTIONED_REPEAT = ["onedrive.live.com", "sharepoint.com", "office365.com", "microsoftonline.com", "googleapis.com",
                     "drive.google.com", "dropbox.com", "box.com", "amazonaws.com", "blob.core.windows.net", "icloud.com"]
UPLOAD_SITES = ["mega.nz", "mega.io", "anonfiles.com", "transfer.sh", "file.io", "wetransfer.com", "gofile.io",
                "pastebin.com", "temp.sh", "ufile.io", "filebin.net"]
UPLOAD_LOOKUPS = ["mega.nz", "anonfiles.com", "transfer.sh", "gofile.io", "temp.sh", "ufile.io", "filebin.net"]
DYNAMIC_DNS = ["duckdns.org", "no-ip.org", "no-ip.com", "ddns.net", "hopto.org", "zapto.org", "sytes.net", "dynu.com",
               "ngrok.io", "ngrok-free.app", "serveo.net", "localtunnel.me"]
DROPPERS = ["winword.exe", "excel.exe", "outlook.exe", "powerpnt.exe", "chrome.exe", "msedge.exe", "firefox.exe"]
RECON_TOOLS = ["whoami.exe", "systeminfo.exe", "nltest.exe", "ipconfig.exe", "arp.exe", "nslookup.exe", "tasklist.exe",
               "quser.exe", "qwinsta.exe", "netstat.exe", "dsquery.exe", "adfind.exe", "route.exe", "hostname.exe",
               "net.exe", "net1.exe", "reg.exe", "wmic.exe"]
TEMP_ALLOWED = ["msiexec.exe", "setup.exe", "chrome.exe", "msedge.exe", "teams.exe", "update.exe"]
PROTECTION_SERVICES = ["WinDefend", "Sense", "MsMpSvc", "wscsvc", "CrowdStrike", "SentinelAgent"]
LSASS_READERS = ["wmiprvse.exe", "msmpeng.exe", "mssense.exe", "sensendr.exe", "csfalconservice.exe", "csfalcon.exe",
                 "taskmgr.exe", "lsass.exe", "services.exe", "wininit.exe", "csrss.exe", "sqlservr.exe", "procexp64.exe",
                 "procexp.exe", "vmtoolsd.exe", "sppsvc.exe"]
REMOTE_TOOLS = ["psexec.exe", "psexesvc.exe", "paexec.exe", "winrs.exe", "wmic.exe", "crackmapexec.exe", "smbexec.py",
                "wmiexec.py"]
ELEVATED = ["administrator", "admin", "system", "root", "domain_admin", "SeDebugPrivilege", "SeTcbPrivilege"]
PRIVILEGED_GROUPS = ["Administrators", "Domain Admins", "Enterprise Admins", "Schema Admins", "sudo", "wheel",
                     "Remote Desktop Users", "Backup Operators"]
AUTO_ELEVATED = ["fodhelper.exe", "eventvwr.exe", "computerdefaults.exe", "sdclt.exe", "slui.exe"]
LOCKED_ENDINGS = [".locked", ".encrypted", ".crypt", ".enc", ".lock", ".akira", ".lockbit", ".blackcat", ".conti", ".ryk", ".phobos"]
# extended rights of directory replication
REPLICATION_RIGHTS = ["1131f6aa-9c07-11d1-f79f-00c04fc2dcd2", "1131f6ad-9c07-11d1-f79f-00c04fc2dcd2", "89e95b76-444d-4c62-991a-0facbeda640c",
                      "ds-replication-get-changes"]
RECON_NOUNS = ["aduser", "adcomputer", "adgroup", "addomain", "netuser", "domaincomputer", "localuser", "localgroup", "process", "service", "hotfix",
               "wmiobject", "ciminstance", "netadapter", "netipconfiguration", "smbshare", "childitem", "nettcpconnection"]
BUILT_IN_TECHNIQUES = {
    "ANOM-LOGIN-HOUR": ["T1078"], "ANOM-LOGIN-LOCATION": ["T1078", "T1133"], "ANOM-EGRESS-VOLUME": ["T1048", "T1041"],
    "ANOM-RARE-PROCESS": ["T1204"], "ANOM-DNS-ENTROPY": ["T1071.004", "T1568.002"], "ANOM-DNS-BURST": ["T1071.004"],
    "TI-IP": ["T1071.001"], "TI-CIDR": ["T1071.001"], "TI-DOMAIN": ["T1071.001", "T1568"], "TI-URL": ["T1105", "T1566.002"],
    "TI-HASH": ["T1204.002"],
}
# ------------------------------------------------------------------------------------------------



def _command(*words: str) -> dict:
    """A started process whose command line contains one of the words."""
    return {"event_type": "process_start", "command_line": {"contains": list(words)}}


def _in_order(*groups: list[str]) -> dict:
    """A started process whose command line names one word of each group, in this order."""
    steps = ["(?:" + "|".join(re.escape(w) for w in g) + ")" for g in groups]
    return {"event_type": "process_start", "command_line": {"regex": "(?i)" + ".*".join(steps)}}


def _path(*words: str) -> dict:
    return {"file_path": {"contains": list(words)}}


def _ending(*words: str) -> dict:
    return {"file_path": {"endswith": list(words)}}


# PowerShell takes every prefix of a switch; the argument is base64.
ENCODED = r"(?i)(?:^|\s)[-/](?:ec|" + "|".join("encodedcommand"[:n] for n in range(14, 0, -1)) + r")\s+[\"']?[a-z0-9+/]{16,}"
NOTES = [f"{a}{s}to{s}{b}" for a in ("how", "readme") for s in ("_", "-", " ", "") for b in ("recover", "decrypt", "restore")] + [
    f"restore{s}{b}" for s in ("_", "-", " ", "") for b in ("files", f"my{s}files")]
SHADOWS_DELETED = [_in_order(["vssadmin"], ["delete"], ["shadow"]), _in_order(["wmic"], ["shadowcopy"], ["delete"]), _in_order(["win32_shadowcopy"], ["delete", "remove"])]
ARCHIVES = [".zip", ".7z", ".rar", ".tar.gz"]
RUN_CODE = ["iex", "invoke-expression"]
FETCH = ["net.webclient", "downloadstring", "downloadfile", "downloaddata", "invoke-webrequest", "invoke-restmethod", "iwr", "curl", "wget", "start-bitstransfer"]
DUMPERS = [_command("mimikatz", "sekurlsa", "lsadump", "logonpasswords"), _in_order(["procdump"], ["lsass"]), _in_order(["comsvcs"], ["minidump"]), _in_order(["reg"], ["save"], ["hklm"])]
REMOTE_RUNS = [_command("psexec", "paexec", "enter-pssession", "new-pssession"), _in_order(["wmic"], ["/node:"]), _in_order(["invoke-command", "invoke-wmimethod", "icm "], ["computername"]), _in_order(["winrs"], ["-r:", "/r:"])]
NET_LISTS = {"event_type": "process_start", "command_line": {"startswith": [
    f"{tool}{end} {what}" for tool in ("net", "net1") for end in ("", ".exe") for what in ("user", "group", "localgroup", "view", "share", "accounts")]}}
PAYLOADS = ["powershell", "pwsh", "cmd.exe", "cmd /c", "mshta", "rundll32", "regsvr32", "wscript", "cscript", ".ps1", ".vbs", ".js", ".bat", "\\temp\\", "appdata"]
# Procedures of the discovery techniques, as their public pages describe them.
SURVEYS = {
    "T1083": ["dir /s", "dir /a", "tree /f", "forfiles", "where /r", "get-childitem -recurse", "gci -r", "find / ", "ls -lr", "locate "],
    "T1057": ["tasklist", "qprocess", "get-process", "wmic process", "win32_process", "ps aux", "ps -ef"],
    "T1082": ["systeminfo", "msinfo32", "get-computerinfo", "wmic os ", "win32_operatingsystem", "uname -a", "sw_vers", "lscpu"],
    "T1518": ["wmic product", "win32_product", "get-package", "currentversion\\uninstall", "dpkg -l", "rpm -qa", "apt list"],
}
# Files in which programs keep secrets, by what reads them.
SECRET_FILES = {
    "shell": ["id_rsa", "id_dsa", "id_ed25519", ".pem", ".ppk"],
    "vault": [".kdbx", ".psafe3", ".opvault"],
    "browser": ["logins.json", "key4.db", "login data"],
    "client": [".netrc", ".pgpass", ".git-credentials", ".my.cnf", ".rdp"],
    "deployment": ["unattend.xml", "groups.xml", "web.config", "wp-config.php", ".env"],
}
SECRET_FOLDERS = [f"{side}{name}{side}" for name in (".ssh", ".aws", ".azure", ".kube", ".docker", ".gnupg", "gcloud") for side in ("/", "\\")]
SEARCHES, SEARCHED = ["findstr", "grep", "select-string", "reg query"], ["passw", "pwd", "credential", "secret", "api_key", "token"]
# Archiving utilities with the switches that pack a tree or lock the result.
ARCHIVERS = {"7z": [" a "], "rar": [" a "], "winzip": [" -a", " -s"], "zip": [" -r", " -e", " -p"], "tar": [" -c", " c"], "makecab": [" /f", " /d"],
             "compress-archive": [" -path", " -literalpath"]}

LOGIN = {"event_type": "authentication", "action": "login_success"}
FAILURE = {"event_type": "authentication", "action": "login_failure"}
PUBLIC = {"dst_ip": {"private": False}}
START = {"event_type": "process_start"}


def _rule(rule_id: str, title: str, severity: str, score: float, confidence: float, phase: str, techniques: list[str], **more) -> RuleSpec:
    return RuleSpec(id=rule_id, title=title, severity=severity, score=score, confidence=confidence, phase=phase,
                    techniques=techniques, **{"group_by": ["host"], **more})


INJECTION_AND_COVERAGE = [
    _rule("INJ-001", "Thread created inside another process", "high", 55, 0.85, "defense_evasion", ["T1055", "T1055.002"],
          where={"event_type": "process_access", "action": "remote_thread",
                 "any_of": [{"tags": {"contains": "lsass_inject"}}, {"process_name": {"in": INJECTORS}}]}),
    _rule("CRED-004", "Directory secrets or replication read", "high", 55, 0.8, "credential_access", ["T1003.003", "T1003.004", "T1003.006"],
          where={"event_type": "security_alert", "action": "directory_object_access",
                 "any_of": [{"ObjectType": {"in": ["SecretObject"]}},
                            {"Properties": {"contains": REPLICATION_RIGHTS}}]}),
    _rule("DEFEV-004", "Security audit log wiped", "high", 55, 0.95, "defense_evasion", ["T1070.001"],
          where={"event_type": "security_alert", "action": "audit_log_cleared"}),
    _rule("PERS-006", "New scheduled task", "medium", 35, 0.7, "persistence", ["T1053.005"], cooldown_seconds=300,
          where={"event_type": "scheduled_task", "action": "created"}),
    _rule("DISC-002", "Run of file and process listings", "low", 25, 0.8, "discovery", ["T1083", "T1057", "T1082", "T1518"],
          kind="threshold", window_seconds=300, count_gte=4, distinct="command_line", cooldown_seconds=1800,
          where={"any_of": [_command(*words) for words in SURVEYS.values()]}),
    _rule("CRED-005", "Stored credentials searched or opened", "medium", 40, 0.75, "credential_access", ["T1552.001"],
          where={"event_type": {"in": ["file_read", "file_create", "process_start"]}, "any_of": [
              *[_ending(*names) for names in SECRET_FILES.values()], _path(*SECRET_FOLDERS), _in_order(SEARCHES, SEARCHED)]}),
]

AUTHENTICATION = [
    _rule("AUTH-001", "Password guessing that succeeded", "high", 55, 0.92, "credential_access", ["T1110.001", "T1078"],
          kind="threshold", group_by=["user"], window_seconds=180, count_gte=5, where=FAILURE, then=LOGIN),
    _rule("AUTH-002", "One source fails on many accounts", "high", 50, 0.9, "credential_access", ["T1110.003"],
          kind="threshold", group_by=["src_ip"], window_seconds=300, count_gte=10, distinct="user", where=FAILURE),
    _rule("AUTH-003", "Many failures on one account", "medium", 30, 0.8, "credential_access", ["T1110.001"],
          kind="threshold", group_by=["user"], window_seconds=600, count_gte=20, cooldown_seconds=1800, where=FAILURE),
    _rule("AUTH-004", "Login from a country off the list", "medium", 35, 0.7, "initial_access", ["T1078", "T1133"], group_by=["user"],
          where={**LOGIN, "geo_country": {"exists": True, "not_in": APPROVED_COUNTRIES}}),
    _rule("AUTH-005", "Decoy account used", "critical", 70, 0.95, "initial_access", ["T1078"], group_by=["user"],
          where={"event_type": "authentication", "user": {"startswith": ["svc-honey", "honey-"]}}),
    _rule("AUTH-006", "Two countries within the hour", "high", 50, 0.75, "initial_access", ["T1078"],
          kind="sequence", group_by=["user"], window_seconds=3600,
          steps=[{**LOGIN, "geo_country": "IN"}, {**LOGIN, "geo_country": {"exists": True, "not_in": ["IN"]}}]),
    _rule("AUTH-007", "Service account at the keyboard", "medium", 35, 0.8, "initial_access", ["T1078.002"], group_by=["user"],
          where={**LOGIN, "user": {"startswith": ["svc-", "svc_"]}, "privilege": {"in": ["interactive", "rdp"]},
                 "not": {"user": {"startswith": ["svc-honey"]}}}),
]

FOREIGN_LOGIN = {**LOGIN, "geo_country": {"exists": True, "not_in": APPROVED_COUNTRIES}}
CHAINS = [
    _rule("BEHAV-001", "Document opens a script host that calls out", "critical", 65, 0.93, "execution", ["T1566.001", "T1059.001", "T1071.001"],
          kind="sequence", window_seconds=600,
          steps=[{**START, "parent_process_name": {"in": OFFICE}, "process_name": {"in": SCRIPT_HOSTS}},
                 {"event_type": "network_connection", "process_name": {"in": SCRIPT_HOSTS}, **PUBLIC}]),
    _rule("BEHAV-002", "Encoded shell, call-out, archive, upload", "critical", 80, 0.95, "exfiltration", ["T1059.001", "T1071.001", "T1560.001", "T1041"],
          kind="sequence", window_seconds=1800,
          steps=[{**START, "process_name": {"in": POWERSHELL}, "command_line": {"regex": ENCODED}},
                 {"event_type": "network_connection", **PUBLIC},
                 {"event_type": "file_create", **_ending(*ARCHIVES)},
                 {"event_type": "network_connection", **PUBLIC, "bytes_out": {"gte": 10_000_000}}]),
    _rule("BEHAV-003", "Login, elevation, foothold", "critical", 65, 0.9, "persistence", ["T1078", "T1068", "T1543.003"],
          kind="sequence", window_seconds=1800,
          steps=[LOGIN, {"event_type": "privilege_change"},
                 {"any_of": [{"event_type": "service_started", "action": "installed"}, {"event_type": "scheduled_task", "action": "created"}]}]),
    _rule("BEHAV-004", "Archive built and sent out", "high", 60, 0.9, "exfiltration", ["T1560.001", "T1048"],
          kind="sequence", window_seconds=1800,
          steps=[{"event_type": "file_create", **_ending(*ARCHIVES, ".tgz"), "file_size": {"gte": 10_000_000}},
                 {"event_type": "network_connection", **PUBLIC, "bytes_out": {"gte": 10_000_000}}]),
    _rule("BEHAV-005", "Recon, credential dump, remote run", "critical", 75, 0.95, "lateral_movement", ["T1087", "T1003.001", "T1021.002"],
          kind="sequence", window_seconds=3600,
          steps=[{**START, "any_of": [{"process_name": {"in": ["whoami.exe", "nltest.exe", "systeminfo.exe", "net.exe", "net1.exe"]}}, NET_LISTS]},
                 {"any_of": DUMPERS}, {"any_of": REMOTE_RUNS}]),
    _rule("BEHAV-006", "Backups removed, then a ransom note", "critical", 85, 0.96, "impact", ["T1490", "T1486"],
          kind="sequence", window_seconds=1800,
          steps=[{"any_of": SHADOWS_DELETED}, {"event_type": "file_create", **_path(*NOTES)}]),
    _rule("BEHAV-007", "Foreign login, then a shell", "high", 55, 0.85, "initial_access", ["T1078", "T1059"],
          kind="sequence", window_seconds=1800,
          steps=[FOREIGN_LOGIN, {**START, "process_name": {"in": ["powershell.exe", "pwsh.exe", "cmd.exe", "wscript.exe", "mshta.exe"]}}]),
]

DATA_MOVEMENT = [
    _rule("COLL-001", "Large archive written", "medium", 40, 0.8, "collection", ["T1560.001", "T1074.001"],
          where={"event_type": "file_create", **_ending(*ARCHIVES, ".tgz", ".cab"), "file_size": {"gte": 20_000_000}}),
    _rule("COLL-002", "Archiver with password or recursion", "medium", 40, 0.85, "collection", ["T1560.001"],
          where={"any_of": [_in_order([tool], switches) for tool, switches in ARCHIVERS.items()]}),
    _rule("COLL-003", "Mass reads on sensitive shares", "medium", 35, 0.8, "collection", ["T1039", "T1005"],
          kind="threshold", group_by=["user"], window_seconds=300, count_gte=200, cooldown_seconds=1800,
          where={"event_type": "file_read", "any_of": [
              {"file_path": {"startswith": "\\\\", "contains": [f"\\{share}" for share in ("finance", "hr", "legal", "shared", "documents")]}},
              _path("/srv/share", "/mnt/share")]}),
    _rule("C2-001", "Steady contact with one address", "high", 50, 0.8, "command_and_control", ["T1071.001", "T1573"],
          kind="threshold", group_by=["host", "dst_ip"], window_seconds=1800, count_gte=25, cooldown_seconds=3600,
          where={"event_type": "network_connection", **PUBLIC, "domain": {"exists": False}}),
    _rule("C2-002", "Public address on a control port", "high", 45, 0.85, "command_and_control", ["T1571", "T1071"],
          where={"event_type": "network_connection", **PUBLIC, "dst_port": {"in": CONTROL_PORTS}}),
    _rule("C2-003", "Script host on the network", "high", 50, 0.9, "command_and_control", ["T1059.001", "T1071.001"],
          where={"event_type": "network_connection", "process_name": {"in": CONNECTING_HOSTS}, **PUBLIC}),
    _rule("EXFIL-001", "Large upload outside approved clouds", "high", 55, 0.85, "exfiltration", ["T1048", "T1041"],
          where={"event_type": "network_connection", **PUBLIC, "bytes_out": {"gte": 50_000_000}, "not": {"domain": {"endswith": SANCTIONED}}}),
    _rule("EXFIL-002", "File-sharing site used", "high", 50, 0.8, "exfiltration", ["T1567.002"],
          where={"any_of": [{"event_type": "network_connection", "domain": {"endswith": UPLOAD_SITES}, "bytes_out": {"gte": 5_000_000}},
                            {"event_type": "dns_query", "domain": {"endswith": UPLOAD_LOOKUPS}}]}),
    _rule("EXFIL-003", "Repeated large transfers to one address", "high", 50, 0.85, "exfiltration", ["T1041", "T1030"],
          kind="threshold", group_by=["host", "dst_ip"], window_seconds=3600, count_gte=8, cooldown_seconds=3600,
          where={"event_type": "network_connection", **PUBLIC, "bytes_out": {"gte": 25_000_000}, "not": {"domain": {"endswith": SANCTIONED_REPEAT}}}),
    _rule("FILE-001", "Mass encryption of files", "critical", 75, 0.95, "impact", ["T1486"],
          kind="threshold", window_seconds=60, count_gte=150, cooldown_seconds=600,
          where={"event_type": {"in": ["file_modify", "file_create"]}, **_ending(*LOCKED_ENDINGS)}),
    _rule("FILE-002", "Ransom note written", "critical", 70, 0.95, "impact", ["T1486"],
          where={"event_type": "file_create", **_path(*NOTES, *[f"decrypt{s}instructions" for s in ("_", "-", " ", "")], "!!!read", "!!!_read", "!!! read")}),
    _rule("FILE-003", "Credential file read", "high", 45, 0.85, "credential_access", ["T1552.001", "T1555.003", "T1552.004"],
          where={"event_type": "file_read", "any_of": [
              *[_ending(*names) for names in SECRET_FILES.values()], _path(*SECRET_FOLDERS), _ending("/etc/shadow"), _path("password")]}),
    _rule("FILE-004", "Office or browser wrote a program", "high", 45, 0.85, "initial_access", ["T1566.001", "T1204.002"],
          where={"event_type": "file_create", "process_name": {"in": DROPPERS}, **_ending(".exe", ".dll", ".ps1", ".vbs", ".js", ".hta", ".scr", ".bat", ".cmd", ".lnk")}),
    _rule("DNS-001", "Dynamic-DNS or tunnel provider", "medium", 35, 0.8, "command_and_control", ["T1071.004", "T1568"],
          where={"event_type": "dns_query", "domain": {"endswith": DYNAMIC_DNS}}),
    _rule("DNS-002", "Many failed lookups", "medium", 40, 0.85, "command_and_control", ["T1568.002"],
          kind="threshold", window_seconds=120, count_gte=50, cooldown_seconds=1800,
          where={"event_type": "dns_query", "outcome": {"in": ["failure", "nxdomain"]}}),
    _rule("DNS-003", "Many TXT lookups", "medium", 40, 0.8, "command_and_control", ["T1071.004", "T1048.003"],
          kind="threshold", window_seconds=300, count_gte=20, cooldown_seconds=1800, where={"event_type": "dns_query", "protocol": "TXT"}),
]

EXECUTION = [
    _rule("EXEC-001", "PowerShell with an encoded command", "high", 55, 0.93, "execution", ["T1059.001", "T1027.010"],
          where={**START, "process_name": {"in": [*POWERSHELL, "powershell_ise.exe"]}, "command_line": {"regex": ENCODED}}),
    _rule("EXEC-002", "Office program started a shell", "high", 55, 0.92, "execution", ["T1566.001", "T1204.002", "T1059"],
          where={**START, "parent_process_name": {"in": [*OFFICE, "acrord32.exe", "onenote.exe"]}, "process_name": {"in": OFFICE_CHILDREN}}),
    _rule("EXEC-003", "PowerShell fetches and runs code", "high", 50, 0.9, "execution", ["T1059.001", "T1105"],
          where={**START, "process_name": {"in": POWERSHELL}, "any_of": [_in_order(RUN_CODE, FETCH), _in_order(FETCH, RUN_CODE)]}),
    _rule("EXEC-004", "System binary given a web address", "high", 50, 0.9, "defense_evasion", ["T1218", "T1105"],
          where={**START, "process_name": {"in": URL_LOADERS}, "command_line": {"contains": ["http://", "https://"]}}),
    _rule("EXEC-005", "Program run from a temporary folder", "medium", 25, 0.7, "execution", ["T1204.002"],
          where={**START, "any_of": [_path("\\temp\\", "\\downloads\\", "\\users\\public\\"), {"file_path": {"startswith": ["/tmp/", "/dev/shm/"]}}],
                 "process_name": {"not_in": TEMP_ALLOWED}}),
    _rule("EXEC-006", "Hidden PowerShell with policy bypass", "medium", 40, 0.85, "execution", ["T1059.001", "T1564.003"],
          where={**_in_order(["-ep", "-exec"], ["bypass"]), "process_name": {"in": POWERSHELL}, "any_of": [_in_order(["-w"], ["hidden"]), _command("-nop")]}),
    _rule("DEFEV-001", "Protection switched off", "critical", 65, 0.95, "defense_evasion", ["T1562.001"],
          where={"any_of": [
              _in_order(["set-mppreference", "add-mppreference"], ["disablerealtimemonitoring", "disableioavprotection", "disablebehaviormonitoring", "exclusionpath"]),
              {"event_type": "service_stopped", "service_name": {"in": PROTECTION_SERVICES}},
              _command("stop windefend"), _in_order(["taskkill"], ["msmpeng"])]}),
    _rule("DEFEV-002", "Event log clearing command", "critical", 65, 0.95, "defense_evasion", ["T1070.001"],
          where=_command(*[f"wevtutil{e} {v}" for e in ("", ".exe") for v in ("cl ", "clear-log")], "clear-eventlog", "remove-eventlog")),
    _rule("DEFEV-003", "Backups and shadow copies removed", "critical", 70, 0.96, "impact", ["T1490"],
          where={"any_of": [*SHADOWS_DELETED, _in_order(["bcdedit"], ["recoveryenabled"], ["no"]), _command("wbadmin delete", "wbadmin.exe delete")]}),
    _rule("DISC-001", "Run of reconnaissance commands", "medium", 35, 0.85, "discovery",
          ["T1087.002", "T1082", "T1016", "T1018", "T1069.002", "T1083", "T1057"],
          kind="threshold", window_seconds=300, count_gte=4, distinct="command_line", cooldown_seconds=600,
          where={**START, "any_of": [
              {"process_name": {"in": RECON_TOOLS}}, NET_LISTS,
              _command(*[f"get-{noun}" for noun in RECON_NOUNS], "[system.directoryservices", "gethost", "test-connection", "systeminfo", "ipconfig /all", "arp -a", "route print", "nltest /", "whoami /")]}),
    _rule("CRED-001", "Credential store dumped", "critical", 75, 0.96, "credential_access", ["T1003.001", "T1003.002", "T1003.003"],
          where={"any_of": [
              *DUMPERS, _in_order(["ntdsutil"], ["ifm"]),
              {"event_type": "file_read", **_ending("\\ntds.dit", "\\system32\\config\\sam", "\\lsass.dmp")}]}),
    _rule("CRED-002", "Kerberos ticket roasting", "high", 50, 0.9, "credential_access", ["T1558.003"],
          where={"any_of": [_command("invoke-kerberoast", "getuserspns", "setspn -t", "setspn -q"), _in_order(["rubeus"], ["kerberoast"])]}),
    _rule("CRED-003", "Memory of the logon service opened", "high", 55, 0.8, "credential_access", ["T1003.001"],
          where={"event_type": "process_access", "file_path": {"endswith": "lsass.exe"}, "tags": {"contains": "lsass_access"},
                 "not": {"process_name": {"in": LSASS_READERS}}}),
    _rule("EXEC-007", "Hostile PowerShell script block", "high", 50, 0.85, "execution", ["T1059.001", "T1027.010"],
          where={**START, "action": "script_block", "any_of": [
              {"command_line": {"regex": ENCODED}},
              _command("frombase64string", "invoke-expression", "invoke-mimikatz", "invoke-shellcode", "iex(", "iex (", "net.webclient", "downloadstring", "downloadfile",
                       "amsiutils", "amsiscanbuffer", "virtualalloc", "createthread", "getprocaddress", "[char][", "[char] ["),
              _in_order(["reflection.assembly"], ["load"])]}),
]

LATERAL = [
    _rule("LAT-001", "One account on many hosts", "high", 50, 0.85, "lateral_movement", ["T1021", "T1078"],
          kind="threshold", group_by=["user"], window_seconds=900, count_gte=4, distinct="host",
          where={**LOGIN, "privilege": {"in": ["network", "remote", "rdp", "winrm", "smb", "ssh"]}}),
    _rule("LAT-002", "Remote execution tool", "high", 50, 0.9, "lateral_movement", ["T1021.002", "T1021.006", "T1047", "T1569.002"],
          where={**START, "any_of": [{"process_name": {"in": REMOTE_TOOLS}}, *REMOTE_RUNS]}),
    _rule("LAT-003", "File shares of several hosts opened", "medium", 40, 0.75, "lateral_movement", ["T1021.002", "T1018"],
          kind="threshold", window_seconds=600, count_gte=3, distinct="dst_ip", cooldown_seconds=1800,
          where={"event_type": "network_connection", "dst_port": 445, "dst_ip": {"private": True}}),
    _rule("LAT-004", "Workstation opens remote desktop inside", "medium", 40, 0.75, "lateral_movement", ["T1021.001", "T1021.006"],
          where={"event_type": "network_connection", "dst_port": {"in": [3389, 5985, 5986]}, "host": {"startswith": ["WS-", "LT-", "PC-"]},
                 "dst_ip": {"private": True}}),
    _rule("LAT-005", "Failed contacts with many inside hosts", "medium", 40, 0.85, "discovery", ["T1046", "T1018"],
          kind="threshold", window_seconds=60, count_gte=15, distinct="dst_ip", cooldown_seconds=1800,
          where={"event_type": "network_connection", "dst_ip": {"private": True}, "outcome": {"in": ["failure", "blocked", "refused"]}}),
    _rule("LAT-006", "NTLM network login of an admin", "high", 50, 0.8, "lateral_movement", ["T1550.002"], group_by=["user"],
          where={**LOGIN, "privilege": "network", "protocol": "ntlm", "user": {"startswith": ["adm-", "da-", "administrator"]}}),
]

PRIVILEGE_AND_PERSISTENCE = [
    _rule("PRIV-001", "Session became privileged", "high", 50, 0.85, "privilege_escalation", ["T1068", "T1548.002"],
          where={"event_type": "privilege_change", "privilege": {"in": ELEVATED}}),
    _rule("PRIV-002", "Member added to a privileged group", "high", 55, 0.92, "privilege_escalation", ["T1098", "T1078"],
          where={"event_type": "group_change", "action": "member_added", "privilege": {"in": PRIVILEGED_GROUPS}}),
    _rule("PRIV-003", "New account put into a group", "critical", 65, 0.93, "persistence", ["T1136.001", "T1098"],
          kind="sequence", window_seconds=600, steps=[{"event_type": "user_created"}, {"event_type": "group_change", "action": "member_added"}]),
    _rule("PRIV-004", "Auto-elevation abused", "high", 50, 0.9, "privilege_escalation", ["T1548.002"],
          where={"any_of": [
              {**START, "parent_process_name": {"in": AUTO_ELEVATED}, "process_name": {"in": ["cmd.exe", "powershell.exe", "pwsh.exe"]}},
              {"event_type": "registry_change", **_path(*[f"{c}\\shell\\open\\command" for c in ("ms-settings", "mscfile", "exefile")])}]}),
    _rule("PRIV-005", "Linux elevation by sudo or setuid", "high", 50, 0.85, "privilege_escalation", ["T1548.001", "T1548.003"],
          where={"source": "linux", "any_of": [
              {"event_type": "privilege_change", "privilege": "root", "action": {"in": ["sudo_success", "setuid"]}},
              _command("chmod u+s", "chmod g+s", "chmod +s", "-perm -4000", "-perm -u=s"),
              {**START, "command_line": {"regex": r"chmod\s+[4-7][0-7]{3}\b"}}]}),
    _rule("PERS-001", "Task with a script payload", "high", 45, 0.88, "persistence", ["T1053.005"],
          where={"any_of": [
              {"event_type": "scheduled_task", "action": "created", "command_line": {"contains": PAYLOADS}},
              _in_order(["schtasks"], ["/create"], PAYLOADS), _command("register-scheduledtask")]}),
    _rule("PERS-002", "Service binary in an odd place", "high", 50, 0.88, "persistence", ["T1543.003"],
          where={"any_of": [
              {"event_type": "service_started", "action": "installed",
               **_path("\\temp\\", "\\users\\public\\", "\\programdata\\", "appdata", "powershell", "cmd.exe", "rundll32")},
              _in_order(["sc ", "sc.exe "], ["create"], ["binpath"], ["temp", "public", "appdata", "powershell", "cmd.exe"])]}),
    _rule("PERS-003", "Autorun registry value", "medium", 40, 0.85, "persistence", ["T1547.001"],
          where={"event_type": "registry_change", **_path("\\currentversion\\run"),
                 "action": {"in": ["set_value", "create", "modified"]}}),
    _rule("PERS-004", "Linux start-up or key file changed", "medium", 40, 0.85, "persistence", ["T1053.003", "T1543.002", "T1098.004"],
          where={"source": "linux", "any_of": [
              {"event_type": "file_modify", **_path("/etc/cron", "/etc/systemd/system/", "/etc/rc.local", "/etc/ld.so.preload", "/var/spool/cron", ".ssh/authorized_keys")},
              _command("crontab -", "systemctl enable"), _in_order([">>"], ["authorized_keys"])]}),
    _rule("PERS-005", "Permanent WMI subscription", "high", 50, 0.9, "persistence", ["T1546.003"],
          where={"any_of": [_command("commandlineeventconsumer", "activescripteventconsumer", "__eventfilter", "__filtertoconsumerbinding"), _in_order(["set-wmiinstance"], ["eventconsumer"])]}),
]

RULES: list[RuleSpec] = [*INJECTION_AND_COVERAGE, *AUTHENTICATION, *CHAINS, *DATA_MOVEMENT, *EXECUTION, *LATERAL, *PRIVILEGE_AND_PERSISTENCE]

# A volume variant beside EXFIL-003, which counts events rather than bytes.
CUMULATIVE_UPLOAD = _rule(
    "EXFIL-003V", "Large total sent to one address", "high", 50, 0.85, "exfiltration", ["T1041", "T1030"],
    kind="threshold", group_by=["host", "dst_ip"], window_seconds=3600, cooldown_seconds=3600, sum_field="bytes_out", sum_gte=200_000_000,
    where={"event_type": "network_connection", **PUBLIC, "not": {"domain": {"endswith": SANCTIONED_REPEAT}}})
